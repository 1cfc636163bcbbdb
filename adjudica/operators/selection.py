"""Combining feature rankings and choosing how many features to keep.

These operators act on one row per feature or per feature count, so their windows and broadcasts
are bounded by the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.attach import attach
from adjudica.spec import KNOBS

FAMILIES = ("mutual_information", "model_gain", "permutation")


def normalised_rank(score: str) -> Column:
    """1 for the best score, 0 for the worst, the average for ties; a single feature gets 1."""
    everything = Window.partitionBy(F.lit(0))
    rank = F.rank().over(everything.orderBy(F.desc(score)))
    ties = F.count(F.lit(1)).over(Window.partitionBy(score))
    size = F.count(F.lit(1)).over(everything)
    average = rank + (ties - 1) / 2.0
    return F.coalesce(F.try_divide(size - average, size - F.lit(1.0)), F.lit(1.0))


def rank_consensus(scores: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Mean of the normalised ranks of several scores per feature, best first."""
    ranked = scores.withColumns({f"{f}_rank": normalised_rank(f) for f in families})
    total = sum((F.col(f"{f}_rank") for f in families[1:]), F.col(f"{families[0]}_rank"))
    return ranked.withColumn("consensus", total / len(families)).orderBy(
        F.desc("consensus"), "feature"
    )


def one_standard_error(curve: DataFrame, folds: int = KNOBS.folds) -> DataFrame:
    """The fewest features whose mean is within one standard error of the best mean.

    ``curve`` has the columns k, mean and std, rounded to four places.
    """
    best = curve.agg(
        F.max_by(F.struct("k", "mean", "std"), F.struct("mean", -F.col("k"))).alias("b")
    ).select("b.k", "b.mean", "b.std")
    floor = F.col("_b.mean") - F.col("_b.std") / F.sqrt(F.lit(float(folds)))
    return (
        attach(curve, best, name="_b")
        .where(F.col("mean") >= floor)
        .agg(F.min("k").alias("selected_k"), F.max("_b.k").alias("best_k"))
    )


def marked_curve(curve: DataFrame, folds: int = KNOBS.folds) -> DataFrame:
    """The selection curve with its best and its selected point marked."""
    chosen = one_standard_error(curve, folds)
    return attach(curve, chosen).select(
        *curve.columns,
        (F.col("k") == F.col("_s.best_k")).alias("is_best"),
        (F.col("k") == F.col("_s.selected_k")).alias("is_selected"),
    )
