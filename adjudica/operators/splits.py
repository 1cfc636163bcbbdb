"""Repeatable splits, keyed by the row's key instead of its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.attach import attach
from adjudica.functions.ordering import count_values, order_statistics
from adjudica.spec import KNOBS, TableSpec

DIGITS = 13  # hexadecimal digits of the hash kept: 52 bits, exact in a double


def draw(key: str, seed: int, purpose: str) -> Column:
    """A number in [0, 1) fixed by the key, the seed and the purpose."""
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.lit(purpose))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10)
    return digits.cast("double") / F.lit(float(16**DIGITS))


def _share_cuts(frame: DataFrame, target: str, column: str, shares) -> DataFrame:
    """Per class: the draw below which the given shares of its rows lie."""
    counted = count_values(frame.select(target, column), [target], column)
    positions = {
        f"c{i}": (lambda total, s=share: F.ceil(total * F.lit(float(s)) - 1e-9) - 1)
        for i, share in enumerate(shares)
    }
    return order_statistics(counted, [target], column, positions)


def mark_holdout(
    frame: DataFrame,
    spec: TableSpec,
    share: float = KNOBS.holdout,
    seed: int = KNOBS.seed,
    exact: bool = False,
) -> DataFrame:
    """Add ``is_holdout``.

    The draw does not depend on the class, so both classes give about the same share of rows and
    nothing is shuffled. ``exact`` finds the cut that gives every class its exact share.
    """
    u = draw(spec.key, seed, "holdout")
    if not exact:
        return frame.withColumn("is_holdout", u < share)
    drawn = frame.withColumn("_u", u)
    cuts = _share_cuts(drawn, spec.target, "_u", [share])
    return (
        attach(drawn, cuts, [spec.target], "_c")
        .withColumn("is_holdout", F.coalesce(F.col("_u") <= F.col("_c.c0"), F.lit(False)))
        .drop("_u", "_c")
    )


def split_holdout(frame: DataFrame, spec: TableSpec, **options) -> tuple[DataFrame, DataFrame]:
    """Training rows and holdout rows."""
    marked = mark_holdout(frame, spec, **options)
    return (
        marked.where("not is_holdout").drop("is_holdout"),
        marked.where("is_holdout").drop("is_holdout"),
    )


def assign_folds(
    frame: DataFrame,
    spec: TableSpec,
    folds: int = KNOBS.folds,
    seed: int = KNOBS.seed,
    exact: bool = False,
) -> DataFrame:
    """Add ``fold`` in 0 … folds−1; ``exact`` makes the folds equally large within each class."""
    u = draw(spec.key, seed, "fold")
    if not exact:
        return frame.withColumn("fold", F.floor(u * folds).cast("int"))
    drawn = frame.withColumn("_u", u)
    cuts = _share_cuts(drawn, spec.target, "_u", [i / folds for i in range(1, folds)])
    passed = F.lit(0)
    for i in range(folds - 1):
        passed = passed + F.coalesce((F.col("_u") > F.col(f"_c.c{i}")).cast("int"), F.lit(0))
    return attach(drawn, cuts, [spec.target], "_c").withColumn("fold", passed).drop("_u", "_c")


def class_weights(frame: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (classes · n_class) of each class, from the given training rows."""
    counts = frame.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    weight = F.col("_s.n") / (F.col("_s.classes") * F.col("n").cast("double"))
    return attach(counts, whole).select(target, "n", weight.alias("weight"))
