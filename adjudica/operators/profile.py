"""Profiling a decision table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.attach import attach, long_form, stacked
from adjudica.functions.ordering import count_values, grouped_quantiles, quantile_row
from adjudica.spec import KNOBS, TableSpec

IQR_FENCE = 1.5
Z_LIMIT = 3.0


def overview(frame: DataFrame, key: str | None = None) -> DataFrame:
    """Rows, columns and duplicate rows (those beyond the first of each identical set)."""
    columns = [c for c in frame.columns if c != key]
    sets = frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(columns)).cast("long").alias("columns"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def numeric_summary(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share, range, median, mean, deviation, and bias-corrected skew and kurtosis."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        x = F.col(c).cast("double")
        aggregates.append(
            F.struct(
                F.count(x).alias("n"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.skewness(x).alias("g1"),
                F.kurtosis(x).alias("g2"),
            ).alias(c)
        )
    moments = attach(frame.agg(*aggregates), quantile_row(frame, columns, [0.5]), name="_m")
    entries = []
    for c in columns:
        n = F.col(f"{c}.n").cast("double")
        skew = F.when(n > 2, F.try_divide(F.col(f"{c}.g1") * F.sqrt(n * (n - 1)), n - 2))
        kurtosis = F.when(
            n > 3,
            F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col(f"{c}.g2") + 6),
        )
        missing = (F.col("rows") - F.col(f"{c}.n")) * F.lit(100.0)
        entries.append(
            (
                F.lit(c),
                F.try_divide(missing, F.col("rows")),
                F.col(f"{c}.min"),
                F.get(f"_m.{c}", F.lit(0)),
                F.col(f"{c}.max"),
                F.col(f"{c}.mean"),
                F.col(f"{c}.std"),
                skew,
                kurtosis,
            )
        )
    names = ("feature", "missing_pct", "min", "median", "max", "mean", "std", "skew", "kurtosis")
    return stacked(moments, entries, names)


def category_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each categorical column, missing values as a null value."""
    table = long_form(frame, columns, feature="feature", value="value", cast="string")
    return table.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_summary(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of values, missing share, and the commonest value with its share of all rows."""
    counts = category_counts(frame, columns)
    known = F.col("value").isNotNull()
    return (
        counts.groupBy("feature")
        .agg(
            F.count_if(known).alias("cardinality"),
            F.sum("n").alias("rows"),
            F.sum(F.when(known, F.lit(0)).otherwise(F.col("n"))).alias("missing"),
            # The smallest value wins a tie; min_by needs no ordering of a whole column.
            F.min_by("value", F.when(known, F.struct(-F.col("n"), "value"))).alias("mode"),
            F.max(F.when(known, F.col("n"))).alias("mode_n"),
        )
        .select(
            "feature",
            "cardinality",
            (F.col("missing") * 100.0 / F.col("rows")).alias("missing_pct"),
            "mode",
            (F.col("mode_n") * 100.0 / F.col("rows")).alias("mode_pct"),
        )
    )


def missingness(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and share of every column that has missing values, most first."""
    columns = list(columns or frame.columns)
    row = frame.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    entries = [
        (F.lit(c), F.col(c), F.try_divide(F.col(c) * F.lit(100.0), F.col("_rows"))) for c in columns
    ]
    table = stacked(row, entries, ("feature", "missing_count", "missing_pct"))
    return table.where("missing_count > 0").orderBy(F.desc("missing_pct"), "feature")


def missing_mechanism(
    frame: DataFrame,
    target: str,
    columns: Sequence[str] | None = None,
    delta: float = KNOBS.informative_delta,
) -> DataFrame:
    """Target rate where a value is present and where it is missing.

    A difference of at least ``delta`` makes the missingness informative. One pass, one row of
    aggregates, whatever the number of columns.
    """
    columns = [c for c in (columns or frame.columns) if c != target]
    row = frame.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.avg(target).alias("_base"),
        *[
            F.struct(
                F.count_if(F.col(c).isNull()).alias("missing"),
                F.avg(F.when(F.col(c).isNotNull(), F.col(target))).alias("present_rate"),
                F.avg(F.when(F.col(c).isNull(), F.col(target))).alias("missing_rate"),
            ).alias(c)
            for c in columns
        ],
    )
    entries = [
        (
            F.lit(c),
            F.try_divide(F.col(f"{c}.missing") * F.lit(100.0), F.col("_rows")),
            F.col(f"{c}.present_rate"),
            F.col(f"{c}.missing_rate"),
            F.col(f"{c}.missing_rate") - F.col(f"{c}.present_rate"),
            F.col("_base"),
        )
        for c in columns
    ]
    names = ("feature", "missing_pct", "rate_present", "rate_missing", "delta", "base_rate")
    informative = F.coalesce(F.abs("delta") >= delta, F.lit(False))
    return (
        stacked(row, entries, names)
        .where("missing_pct > 0")
        .withColumn("mechanism", F.when(informative, "informative").otherwise("at random"))
    )


def spread_row(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a struct per column: quartiles, mean and sample deviation."""
    moments = frame.agg(
        *[
            F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c)
            for c in columns
        ]
    )
    both = attach(moments, quantile_row(frame, columns, [0.25, 0.75]), name="_q")
    return both.select(
        *[
            F.struct(
                F.get(f"_q.{c}", F.lit(0)).alias("q1"),
                F.get(f"_q.{c}", F.lit(1)).alias("q3"),
                F.col(f"{c}.mean").alias("mean"),
                F.col(f"{c}.std").alias("std"),
            ).alias(c)
            for c in columns
        ]
    )


def below_fence(value: Column, stats: Column) -> Column:
    return value < stats["q1"] - IQR_FENCE * (stats["q3"] - stats["q1"])


def above_fence(value: Column, stats: Column) -> Column:
    return value > stats["q3"] + IQR_FENCE * (stats["q3"] - stats["q1"])


def far_from_mean(value: Column, stats: Column) -> Column:
    return F.abs(F.try_divide(value - stats["mean"], stats["std"])) > Z_LIMIT


def outlier_summary(
    frame: DataFrame, columns: Sequence[str], nonnegative: Sequence[str] = ()
) -> DataFrame:
    """Values beyond the quartile fences, far from the mean, and impossible negatives."""
    table = attach(frame, spread_row(frame, columns), name="_f")
    row = table.agg(
        *[
            F.struct(
                F.count_if(below_fence(F.col(c), F.col(f"_f.{c}"))).alias("iqr_low"),
                F.count_if(above_fence(F.col(c), F.col(f"_f.{c}"))).alias("iqr_high"),
                F.count_if(far_from_mean(F.col(c), F.col(f"_f.{c}"))).alias("z_over_3"),
                (F.count_if(F.col(c) < 0) if c in nonnegative else F.lit(0).cast("long")).alias(
                    "impossible_negative"
                ),
            ).alias(c)
            for c in columns
        ]
    )
    names = ("feature", "iqr_low", "iqr_high", "z_over_3", "impossible_negative")
    return stacked(row, [(F.lit(c), *[F.col(f"{c}.{n}") for n in names[1:]]) for c in columns], names)


def quantile_edges(frame: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: the distinct edges of ``bins`` equal-count bands, the lowest and highest included."""
    cuts = quantile_row(frame, [column], [i / bins for i in range(bins + 1)])
    return cuts.select(F.array_distinct(column).alias("edges"))


def band_index(value: Column, edges: Column) -> Column:
    """Index of the right-closed band; the lowest value belongs to the first band."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(value.isNotNull(), F.size(F.filter(inner, lambda e: e < value)))


def rate_by_quantile_band(frame: DataFrame, column: str, target: str, bins: int = 5) -> DataFrame:
    """Target rate and row count per equal-count band of a numeric column."""
    table = attach(
        frame.select(column, target).where(F.col(column).isNotNull()),
        quantile_edges(frame, column, bins),
        name="_e",
    )
    table = table.withColumn("band", band_index(F.col(column), F.col("_e.edges")))
    return table.groupBy("band").agg(
        F.first(F.get("_e.edges", F.col("band"))).alias("low"),
        F.first(F.get("_e.edges", F.col("band") + 1)).alias("high"),
        F.avg(target).alias("approval_rate"),
        F.count(F.lit(1)).alias("n"),
    )


# The five recommendations, in order of priority.
RECOMMENDATIONS = {
    "sensitive": "exclude (sensitive attribute); audit for bias",
    "informative": "keep (primary); missingness is itself informative",
    "signal": "keep (predictive)",
    "impossible": "repair impossible values; weak signal",
    "none": "drop candidate (noise)",
}


def decision_table(
    association: DataFrame, mechanism: DataFrame, outliers: DataFrame, spec: TableSpec
) -> DataFrame:
    """Per feature: information, missing share, impossible values, and what to do with it.

    The three inputs have one row per feature, so they are broadcast.
    """
    joined = (
        association.join(
            F.broadcast(mechanism.select("feature", "missing_pct", "mechanism")), "feature", "left"
        )
        .join(F.broadcast(outliers.select("feature", "impossible_negative")), "feature", "left")
        .withColumn("impossible_negatives", F.coalesce("impossible_negative", F.lit(0)))
    )
    signal = F.col("signal") == "signal"
    informative = F.coalesce(F.col("mechanism") == "informative", F.lit(False))
    verdict = (
        F.when(F.col("feature").isin(list(spec.sensitive)), RECOMMENDATIONS["sensitive"])
        .when(signal & informative, RECOMMENDATIONS["informative"])
        .when(signal, RECOMMENDATIONS["signal"])
        .when(F.col("impossible_negatives") > 0, RECOMMENDATIONS["impossible"])
        .otherwise(RECOMMENDATIONS["none"])
    )
    return joined.select(
        "feature",
        "mutual_info",
        F.coalesce("missing_pct", F.lit(0.0)).alias("missing_pct"),
        "impossible_negatives",
        verdict.alias("recommendation"),
    )


def box_statistics(frame: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Quartiles, whisker ends and outlier counts of each column per target level."""
    keys = ["feature", target]
    counted = count_values(long_form(frame, columns, keep=[target]), keys, "value")
    quartiles = grouped_quantiles(counted, keys, "value", [0.25, 0.5, 0.75])
    table = attach(counted, quartiles, keys, "_q")
    low, mid, high = (F.col(f"_q.q{i}") for i in range(3))
    reach = IQR_FENCE * (high - low)
    inside = (F.col("value") >= low - reach) & (F.col("value") <= high + reach)
    return table.groupBy(*keys).agg(
        F.first(low).alias("q1"),
        F.first(mid).alias("median"),
        F.first(high).alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
    )


def histogram(frame: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Rows per equal-width bin of each numeric column; the highest value closes the last bin."""
    table = long_form(frame, columns).where("value is not null")
    ranges = table.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    placed = attach(table, ranges, ["feature"], "_r")
    low, high = F.col("_r.low"), F.col("_r.high")
    share = F.coalesce(F.try_divide((F.col("value") - low) * bins, high - low), F.lit(0.0))
    index = F.least(F.floor(share), F.lit(bins - 1))
    return (
        placed.groupBy("feature", index.alias("bin"), low.alias("_low"), high.alias("_high"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "feature",
            "bin",
            (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("bin") / bins).alias("low"),
            (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("bin") + 1) / bins).alias(
                "high"
            ),
            "n",
        )
    )


def rate_by_category(frame: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Target rate per value of each categorical column beside the rate of all rows."""
    table = long_form(frame, columns, keep=[target], cast="string").where("value is not null")
    rates = table.groupBy("feature", "value").agg(
        F.avg(target).alias("approval_rate"), F.count(F.lit(1)).alias("n")
    )
    return attach(rates, frame.agg(F.avg(target).alias("base_rate"))).select(
        "feature", "value", "approval_rate", "n", F.col("_s.base_rate").alias("base_rate")
    )
