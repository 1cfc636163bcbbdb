"""Where and how a classifier is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.functions.attach import attach, stacked
from adjudica.spec import KNOBS

# The four outcomes, in reporting order.
OUTCOMES = ("true_negative", "false_positive", "false_negative", "true_positive")


def classify(
    scored: DataFrame, threshold: float = KNOBS.threshold, y: str = "y", p: str = "p"
) -> DataFrame:
    """Add the decision, its outcome, whether it is wrong, and how far the score was off."""
    approve, good = F.col(p) >= threshold, F.col(y) == 1
    outcome = (
        F.when(approve & good, "true_positive")
        .when(approve, "false_positive")
        .when(good, "false_negative")
        .otherwise("true_negative")
    )
    return scored.withColumns(
        {
            "predicted": approve.cast("long"),
            "outcome": outcome,
            "is_error": approve != good,
            "confidence_error": F.abs(F.col(p) - F.col(y)),
        }
    )


def error_summary(classified: DataFrame, p: str = "p") -> DataFrame:
    """Count, share and mean probability of each of the four outcomes."""
    is_kind = {k: F.col("outcome") == k for k in OUTCOMES}
    row = classified.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(c).alias(f"n_{k}") for k, c in is_kind.items()],
        *[F.avg(F.when(c, F.col(p))).alias(f"p_{k}") for k, c in is_kind.items()],
    )
    entries = [
        (
            F.lit(k),
            F.col(f"n_{k}"),
            F.try_divide(F.col(f"n_{k}") * F.lit(100.0), F.col("_rows")),
            F.col(f"p_{k}"),
        )
        for k in OUTCOMES
    ]
    return stacked(row, entries, ("outcome", "count", "share_pct", "mean_probability"))


def error_profile(classified: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each numeric column among wrong and right decisions, largest difference first."""
    numeric = {f.name for f in classified.schema if isinstance(f.dataType, T.NumericType)}
    used = [c for c in columns if c in numeric]
    row = classified.agg(
        *[F.avg(F.when(F.col("is_error"), F.col(c))).alias(f"w_{c}") for c in used],
        *[F.avg(F.when(~F.col("is_error"), F.col(c))).alias(f"r_{c}") for c in used],
    )
    entries = [
        (F.lit(c), F.col(f"w_{c}"), F.col(f"r_{c}"), F.col(f"w_{c}") - F.col(f"r_{c}")) for c in used
    ]
    names = ("feature", "mean_when_wrong", "mean_when_right", "difference")
    return stacked(row, entries, names).orderBy(F.desc(F.abs("difference")), "feature")


def _rates() -> list:
    share = lambda c: F.avg(c.cast("long"))
    return [
        F.count(F.lit(1)).alias("applicants"),
        share(F.col("is_error")).alias("error_rate"),
        share(F.col("outcome") == "false_positive").alias("false_positive_rate"),
        share(F.col("outcome") == "false_negative").alias("false_negative_rate"),
    ]


def segment_errors(classified: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Error rates per value of each column beside the rate of all rows.

    False positives and negatives are shares of all rows of the segment; null segments are left out.
    """
    parts = F.array(
        *[F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    table = classified.select("is_error", "outcome", F.inline(parts)).where("value is not null")
    rates = table.groupBy("segment", "value").agg(*_rates())
    whole = classified.agg(F.avg(F.col("is_error").cast("long")).alias("rate"))
    return attach(rates, whole).select(
        *rates.columns, F.col("_s.rate").alias("population_error_rate")
    )


def confident_mistakes(classified: DataFrame, key: str, count: int = 10) -> DataFrame:
    """The wrong decisions the model was surest about."""
    return classified.where("is_error").orderBy(F.desc("confidence_error"), key).limit(count)


def error_histogram(classified: DataFrame, bins: int = 30, p: str = "p") -> DataFrame:
    """Density of the probability among wrong and right decisions, each over the common range."""
    limits = classified.agg(F.min(p).alias("low"), F.max(p).alias("high"))
    table = attach(classified.select("is_error", p), limits, name="_r")
    low, width = F.col("_r.low"), (F.col("_r.high") - F.col("_r.low")) / bins
    place = F.coalesce(F.try_divide(F.col(p) - low, width), F.lit(0.0))
    counts = table.groupBy(
        "is_error",
        F.least(F.floor(place), F.lit(bins - 1)).alias("bin"),
        low.alias("_low"),
        width.alias("_width"),
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("is_error").agg(F.sum("n").alias("all"))
    return attach(counts, totals, ["is_error"], "_t").select(
        "is_error",
        "bin",
        (F.col("_low") + F.col("_width") * F.col("bin")).alias("low"),
        "n",
        F.try_divide(F.col("n").cast("double"), F.col("_t.all") * F.col("_width")).alias("density"),
    )
