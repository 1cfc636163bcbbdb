"""Rule-based outlier flags, and summaries of any set of flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.attach import attach, stacked
from adjudica.operators.profile import above_fence, below_fence, far_from_mean, spread_row
from adjudica.spec import KNOBS, TableSpec

RULES = ("impossible", "iqr", "zscore")


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def rule_flags(frame: DataFrame, spec: TableSpec) -> DataFrame:
    """Add the flags of the three rules; a null value is never an outlier."""
    table = attach(frame, spread_row(frame, spec.numeric), name="_f")
    stats = {c: F.col(f"_f.{c}") for c in spec.numeric}
    fences = [below_fence(F.col(c), s) | above_fence(F.col(c), s) for c, s in stats.items()]
    far = [far_from_mean(F.col(c), s) for c, s in stats.items()]
    present = [c for c in spec.nonnegative if c in frame.columns]
    return table.withColumns(
        {
            "impossible": _any([F.col(c) < 0 for c in present]),
            "iqr": _any(fences),
            "zscore": _any(far),
        }
    ).drop("_f")


def flag_summary(frame: DataFrame, flags: Sequence[str], target: str) -> DataFrame:
    """Per flag: rows, share, target rate of the flagged rows and its distance from the base rate."""
    row = frame.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.avg(target).alias("_base"),
        *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags],
        *[F.avg(F.when(F.col(f), F.col(target))).alias(f"r_{f}") for f in flags],
    )
    entries = [
        (
            F.lit(f),
            F.col(f"n_{f}"),
            F.try_divide(F.col(f"n_{f}") * F.lit(100.0), F.col("_rows")),
            F.col(f"r_{f}"),
            F.col(f"r_{f}") - F.col("_base"),
        )
        for f in flags
    ]
    names = ("method", "flagged", "share_pct", "approval_rate", "approval_lift")
    return stacked(row, entries, names)


def flag_jaccard(frame: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Overlap of every two flags; two flags that never fire agree fully."""
    pairs = list(product(flags, repeat=2))
    row = frame.agg(
        *[F.count_if(F.col(a) & F.col(b)).alias(f"both{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(F.col(a) | F.col(b)).alias(f"any{i}") for i, (a, b) in enumerate(pairs)],
    )
    entries = [
        (
            F.lit(a),
            F.lit(b),
            F.coalesce(F.try_divide(F.col(f"both{i}").cast("double"), F.col(f"any{i}")), F.lit(1.0)),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return stacked(row, entries, ("left", "right", "jaccard"))


def votes(flags: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in flags], F.lit(0))


def consensus(frame: DataFrame, flags: Sequence[str], at_least: int = KNOBS.votes) -> DataFrame:
    """Add ``consensus``: whether enough methods agree that the row is an outlier."""
    return frame.withColumn("consensus", votes(flags) >= at_least)


def flagged_rows(frame: DataFrame, flags: Sequence[str], mask: str = "consensus") -> DataFrame:
    """The masked rows with the names of the methods that fired, in flag order."""
    names = F.concat_ws(", ", *[F.when(F.col(f), F.lit(f)) for f in flags])
    return frame.where(F.col(mask)).withColumn("flagged_by", names)


def remove_flagged(frame: DataFrame, mask: str = "consensus") -> DataFrame:
    return frame.where(~F.col(mask))
