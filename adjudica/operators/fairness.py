"""How decisions fall on protected groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.attach import attach
from adjudica.spec import KNOBS


def fairness_audit(classified: DataFrame, protected: Sequence[str]) -> DataFrame:
    """Selection, error and false decision rates of every group of every protected column."""
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("group"))
            for c in protected
        ]
    )
    share = lambda c: F.round(F.avg(c.cast("long")), 3)
    return (
        classified.select("predicted", "is_error", "outcome", F.inline(parts))
        .where(F.col("group").isNotNull())
        .groupBy("attribute", "group")
        .agg(
            F.count(F.lit(1)).alias("applicants"),
            share(F.col("predicted") == 1).alias("selection_rate"),
            share(F.col("is_error")).alias("error_rate"),
            share(F.col("outcome") == "false_positive").alias("false_positive_rate"),
            share(F.col("outcome") == "false_negative").alias("false_negative_rate"),
        )
    )


def disparate_impact(audit: DataFrame, fair_ratio: float = KNOBS.fair_ratio) -> DataFrame:
    """Lowest over highest selection rate per protected column, and the four-fifths verdict."""
    rates = audit.groupBy("attribute").agg(
        F.min("selection_rate").alias("lowest_selection_rate"),
        F.max("selection_rate").alias("highest_selection_rate"),
        (F.max("false_negative_rate") - F.min("false_negative_rate")).alias("gap"),
    )
    ratio = F.coalesce(
        F.try_divide("lowest_selection_rate", "highest_selection_rate"), F.lit(0.0)
    )
    return rates.select(
        "attribute",
        "lowest_selection_rate",
        "highest_selection_rate",
        F.round(ratio, 3).alias("impact_ratio"),
        (ratio >= fair_ratio).alias("passes_four_fifths"),
        F.round("gap", 3).alias("false_negative_gap"),
    )


def group_rates(audit: DataFrame) -> DataFrame:
    """Group rates beside the plain mean over the groups of the same column."""
    w = Window.partitionBy("attribute")
    return audit.select(
        "attribute",
        "group",
        "selection_rate",
        F.avg("selection_rate").over(w).alias("mean_selection_rate"),
        "error_rate",
        F.avg("error_rate").over(w).alias("mean_error_rate"),
    )


def _group_cells(classified: DataFrame, attribute: str) -> DataFrame:
    return (
        classified.where(F.col(attribute).isNotNull())
        .groupBy(F.col(attribute).cast("string").alias("group"))
        .agg(F.count_if(F.col("predicted") == 1).alias("yes"), F.count(F.lit(1)).alias("n"))
    )


def impact_ratio(
    classified: DataFrame, attribute: str, fair_ratio: float = KNOBS.fair_ratio
) -> DataFrame:
    """Lowest over highest selection rate of one protected column, from unrounded rates."""
    rate = F.col("yes") / F.col("n").cast("double")
    ratio = F.try_divide(F.min(rate), F.max(rate))
    return _group_cells(classified, attribute).agg(
        ratio.alias("impact_ratio"), (ratio >= fair_ratio).alias("passes_four_fifths")
    )


def _resampled(seed: int):
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratios = []
            for replicate, yes, n in zip(batch["replicate"], batch["yes"], batch["n"]):
                yes, n = np.asarray(yes, dtype=float), np.asarray(n, dtype=float)
                cells = np.concatenate([yes, n - yes])
                random = np.random.default_rng([seed, int(replicate)])
                drawn = random.multinomial(int(n.sum()), cells / cells.sum())
                picked, size = drawn[: len(yes)], drawn[: len(yes)] + drawn[len(yes) :]
                rates = picked[size > 0] / size[size > 0]
                usable = len(rates) > 1 and rates.max() > 0
                ratios.append(rates.min() / rates.max() if usable else None)
            yield pd.DataFrame({"replicate": batch["replicate"], "ratio": ratios}).astype(
                {"ratio": "float64"}
            )

    return draw


def impact_interval(
    classified: DataFrame,
    attribute: str,
    resamples: int = KNOBS.resamples,
    seed: int = KNOBS.seed,
    fair_ratio: float = KNOBS.fair_ratio,
) -> DataFrame:
    """Bootstrap interval of the impact ratio.

    Drawing n rows with replacement and counting them per group and decision is one multinomial
    draw over those cells, so each replicate needs the counts only. The rows are aggregated once;
    the work of a replicate grows with the number of groups, not of rows.
    """
    cells = _group_cells(classified, attribute)
    replicates = (
        cells.agg(F.sort_array(F.collect_list(F.struct("group", "yes", "n"))).alias("cells"))
        .select(
            F.col("cells.yes").alias("yes"),
            F.col("cells.n").alias("n"),
            F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("replicate"),
        )
        .repartition("replicate")
    )
    drawn = replicates.mapInPandas(_resampled(seed), "replicate int, ratio double")
    bounds = drawn.agg(
        F.percentile("ratio", 0.025).alias("lower_95"), F.percentile("ratio", 0.975).alias("upper_95")
    )
    point = attach(impact_ratio(classified, attribute, fair_ratio), bounds)
    return point.select(
        "impact_ratio",
        F.col("_s.lower_95").alias("lower_95"),
        F.col("_s.upper_95").alias("upper_95"),
        "passes_four_fifths",
        (F.col("_s.upper_95") < fair_ratio).alias("conclusive"),
    )
