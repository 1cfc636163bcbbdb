"""Association between columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.attach import attach, long_form, stacked
from adjudica.functions.ordering import (
    count_values,
    grouped_quantiles,
    quantile_row,
    running_totals,
)
from adjudica.operators.profile import band_index
from adjudica.spec import KNOBS, TableSpec

MISSING = "\u0000missing"


def _count_cells(frame: DataFrame, columns: Sequence[str], other: str) -> DataFrame:
    """Rows per (feature, value, other), rows with a null left out."""
    return (
        long_form(frame, columns, keep=[other], cast="string")
        .where(F.col("value").isNotNull() & F.col(other).isNotNull())
        .groupBy("feature", "value", other)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _per_level(cells: DataFrame, other: str) -> DataFrame:
    """Sums over the values of each feature, per level of ``other``.

    A feature may have many values, so their totals come from a window over (feature, value), which
    holds one row per level of ``other``. From here on a feature has one row per level.
    """
    value = Window.partitionBy("feature", "value")
    n, of_value = F.col("n").cast("double"), F.col("n_value").cast("double")
    return (
        cells.withColumn("n_value", F.sum("n").over(value))
        .groupBy("feature", other)
        .agg(
            F.sum("n").cast("double").alias("n"),
            F.sum(n * n / of_value).alias("squares"),
            F.sum(n * (F.log(n) - F.log(of_value))).alias("logs"),
            F.sum(n / of_value).alias("values"),
        )
    )


def cramers_v(frame: DataFrame, columns: Sequence[str], other: str) -> DataFrame:
    """Cramér's V of each column with ``other``.

    Without a continuity correction; rows with a null do not count; 0 if a side has one level. With
    o the count of a cell and r, c its totals, χ²/n = Σ o²/(r·c) − 1, which needs no empty cells.
    """
    found = (
        _per_level(_count_cells(frame, columns, other), other)
        .groupBy("feature")
        .agg(
            F.sum(F.col("squares") / F.col("n")).alias("s"),
            F.count(F.lit(1)).alias("levels"),
            F.round(F.sum("values")).alias("values"),
        )
    )
    smaller = F.least("values", "levels") - 1
    value = F.sqrt(F.greatest(F.try_divide(F.col("s") - 1, smaller), F.lit(0.0)))
    names = stacked_names(frame, columns)
    return names.join(F.broadcast(found), "feature", "left").select(
        "feature", F.coalesce(value, F.lit(0.0)).alias("cramers_v")
    )


def stacked_names(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column name, so that a feature without usable rows is still reported."""
    row = frame.agg(F.count(F.lit(1)).alias("_n"))
    return stacked(row, [(F.lit(c),) for c in columns], ("feature",))


def correlation_ratio(frame: DataFrame, category: str, values: Sequence[str]) -> DataFrame:
    """How much of each numeric column's variation lies between the groups of ``category``.

    Rows of the null category count in the total variation only.
    """
    table = long_form(frame, values, keep=[category]).where("value is not null")
    groups = table.groupBy("feature", category).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("var"),
    )
    whole = groups.groupBy("feature").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    )
    spread = F.col("n") * F.pow(F.col("mean") - F.col("_g.grand"), 2)
    found = (
        attach(groups, whole, ["feature"], "_g")
        .groupBy("feature")
        .agg(
            F.sum(F.when(F.col(category).isNotNull(), spread).otherwise(0.0)).alias("between"),
            F.sum(F.col("n") * F.col("var") + spread).alias("total"),
        )
    )
    ratio = F.sqrt(F.try_divide(F.col("between"), F.col("total")))
    return found.select("feature", F.coalesce(ratio, F.lit(0.0)).alias("correlation_ratio"))


def feature_auc(frame: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Area under the ROC curve of each column alone, ties counted half, missing rows left out."""
    counted = count_values(
        long_form(frame, columns, keep=[target]),
        ["feature"],
        "value",
        ones=F.col(target),
    ).withColumn("zeros", F.col("n") - F.col("ones"))
    placed = running_totals(counted, ["feature"], "value", ["ones", "zeros"])
    wins = F.col("ones") * (F.col("before_zeros") + F.col("zeros") / 2.0)
    pairs = F.max("all_ones").cast("double") * F.max("all_zeros")
    return placed.groupBy("feature").agg(F.try_divide(F.sum(wins), pairs).alias("auc"))


def _banded_cells(frame: DataFrame, columns: Sequence[str], target: str, bins: int) -> DataFrame:
    """Rows per (feature, band, target): the table is counted once, per distinct value.

    The edges come from these counts too, and a value finds its band after counting.
    """
    labelled = frame.where(F.col(target).isNotNull())
    counted = count_values(
        long_form(labelled, columns, keep=[target]), ["feature"], "value", ones=F.col(target)
    )
    shares = [i / bins for i in range(bins + 1)] + [0.5]
    found = grouped_quantiles(counted, ["feature"], "value", shares, also=["ones"])
    edges = found.select(
        "feature",
        F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)])).alias("edges"),
        F.col(f"q{bins + 1}").alias("median"),
    )
    # Missing values are counted apart and join the band of the median.
    blank = labelled.agg(
        *[
            F.struct(
                F.count_if(F.col(c).isNull()).alias("n"),
                F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col(target))), F.lit(0)).alias("ones"),
            ).alias(c)
            for c in columns
        ]
    )
    missing = stacked(
        blank,
        [(F.lit(c), F.lit(None).cast("double"), F.col(f"{c}.n"), F.col(f"{c}.ones")) for c in columns],
        ("feature", "value", "n", "ones"),
    )
    placed = attach(counted.unionByName(missing), edges, ["feature"], "_e")
    band = band_index(F.coalesce("value", F.col("_e.median")), F.col("_e.edges"))
    both = F.array(
        F.struct(F.lit(0).cast("long").alias(target), (F.col("n") - F.col("ones")).alias("rows")),
        F.struct(F.lit(1).cast("long").alias(target), F.col("ones").alias("rows")),
    )
    return (
        placed.select("feature", band.cast("string").alias("value"), F.inline(both))
        .groupBy("feature", "value", target)
        .agg(F.sum("rows").alias("n"))
        .where("n > 0")
    )


def binned_information(
    frame: DataFrame, spec: TableSpec, bins: int = 10, numeric=None, categorical=None
) -> DataFrame:
    """Mutual information of each feature with the target, in nats.

    Numeric columns are median-imputed and cut into equal-count bands; a missing category is a level
    of its own. The estimate is the plug-in value over the counted cells.
    """
    numeric = list(spec.numeric if numeric is None else numeric)
    categorical = list(spec.categorical if categorical is None else categorical)
    parts = []
    if numeric:
        parts.append(_banded_cells(frame, numeric, spec.target, bins))
    if categorical:
        filled = frame.select(
            spec.target, *[F.coalesce(F.col(c), F.lit(MISSING)).alias(c) for c in categorical]
        )
        parts.append(_count_cells(filled, categorical, spec.target))
    levels = _per_level(reduce(DataFrame.unionByName, parts), spec.target)
    # Σ o/N · ln(o·N / (r·c)), summed over the values first and the target's levels second.
    n = F.sum("n")
    total = (F.sum("logs") - F.sum(F.col("n") * F.log("n"))) / n + F.log(n)
    return levels.groupBy("feature").agg(F.greatest(total, F.lit(0.0)).alias("mutual_info"))


def target_association(
    frame: DataFrame,
    spec: TableSpec,
    bins: int = 10,
    signal: float = KNOBS.signal_information,
) -> DataFrame:
    """Information of every feature, its AUC or Cramér's V, and whether it carries signal."""
    second = (
        feature_auc(frame, spec.numeric, spec.target)
        .select("feature", F.lit("numeric").alias("type"), F.col("auc").alias("auc_or_cramers_v"))
        .unionByName(
            cramers_v(frame, spec.categorical, spec.target).select(
                "feature",
                F.lit("categorical").alias("type"),
                F.col("cramers_v").alias("auc_or_cramers_v"),
            )
        )
    )
    information = binned_information(frame, spec, bins)
    return information.join(F.broadcast(second), "feature").select(
        "feature",
        "type",
        "mutual_info",
        "auc_or_cramers_v",
        F.when(F.col("mutual_info") >= signal, "signal").otherwise("noise").alias("signal"),
    )


def pearson(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows where both are present."""
    pairs = list(combinations(columns, 2))
    row = frame.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    entries = [(F.lit(a), F.lit(b), F.col(f"p{i}")) for i, (a, b) in enumerate(pairs)]
    return stacked(row, entries, ("left", "right", "pearson"))


def _ranked(pairs: DataFrame, side: str) -> DataFrame:
    """Add the average rank of one side of each pair.

    A value held by more than a thousandth of a pair's rows is looked up through a broadcast table
    of at most a thousand such values per pair; the others are joined on the value. The matched rows
    spread over random keys in that join, so a common value does not meet in one task.
    """
    counted = pairs.groupBy("pair", F.col(side).alias("value")).agg(F.sum("n").alias("n"))
    placed = running_totals(counted, ["pair"], "value", ["n"]).select(
        "pair",
        "value",
        (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"),
        (F.col("n") * 1000 > F.col("all_n")).alias("hot"),
    )
    hot = placed.where("hot").select("pair", F.col("value").alias(side), F.col("rank").alias("_hot"))
    cold = placed.where("not hot").select(
        "pair", F.col("value").alias(side), F.lit(0).alias("_salt"), F.col("rank").alias("_cold")
    )
    first = pairs.join(F.broadcast(hot), ["pair", side], "left")
    spread = 1 + F.pmod(F.xxhash64("pair", "x", "y"), F.lit(1024)).cast("int")
    salted = first.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(spread))
    joined = salted.join(cold, ["pair", side, "_salt"], "left")
    return joined.withColumn(f"rank_{side}", F.coalesce("_hot", "_cold")).drop(
        "_hot", "_cold", "_salt"
    )


def spearman(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of every pair, ranks taken over the rows where both are present."""
    pairs = list(combinations(columns, 2))
    both = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"),
                F.col(a).cast("double").alias("x"),
                F.col(b).cast("double").alias("y"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    counted = (
        frame.select(F.inline(both))
        .where("x is not null and y is not null")
        .groupBy("pair", "x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = _ranked(_ranked(counted, "x"), "y")
    n, x, y = F.col("n"), F.col("rank_x"), F.col("rank_y")
    sums = ranked.groupBy("pair").agg(
        F.sum(n).cast("double").alias("n"),
        (F.sum(n * x) / F.sum(n)).alias("mx"),
        (F.sum(n * y) / F.sum(n)).alias("my"),
        F.sum(n * x * y).alias("xy"),
        F.sum(n * x * x).alias("xx"),
        F.sum(n * y * y).alias("yy"),
    )
    cross = F.col("xy") - F.col("n") * F.col("mx") * F.col("my")
    left = F.col("xx") - F.col("n") * F.col("mx") * F.col("mx")
    right = F.col("yy") - F.col("n") * F.col("my") * F.col("my")
    names: Column = F.element_at(
        F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs]),
        F.col("pair") + 1,
    )
    return sums.select(
        names["left"].alias("left"),
        names["right"].alias("right"),
        F.try_divide(cross, F.sqrt(left) * F.sqrt(right)).alias("spearman"),
    )


BLOCK = 100_000  # distinct values of one class that share a window


def _digamma(x: Column) -> Column:
    """The digamma function for x ≥ 1: shifted up by six, where its asymptotic series is exact."""
    x = x.cast("double")
    y = x + 6.0
    series = (
        F.log(y)
        - F.lit(0.5) / y
        - F.lit(1 / 12) / (y * y)
        + F.lit(1 / 120) / F.pow(y, 4)
        - F.lit(1 / 252) / F.pow(y, 6)
        + F.lit(1 / 240) / F.pow(y, 8)
    )
    return series - reduce(lambda a, b: a + b, [F.lit(1.0) / (x + i) for i in range(6)])


def _class_neighbours(counted: DataFrame, k: int) -> DataFrame:
    """For each (feature, class, value) its k-th nearest row of the same class and the distance.

    Values of a class are numbered in order and cut into blocks of fixed size; the k values on
    either side of a block are copied into it, so a window never holds more than a block.
    """
    keys = ["feature", "class"]
    numbered = running_totals(counted.withColumn("one", F.lit(1)), keys, "value", ["one", "n"])
    place, home = F.pmod("before_one", F.lit(BLOCK)), F.floor(F.col("before_one") / BLOCK)
    blocks = F.array_compact(
        F.array(home, F.when(place < k, home - 1), F.when(place >= BLOCK - k, home + 1))
    )
    copies = numbered.withColumn("home", home).withColumn("block", F.explode(blocks))
    order = Window.partitionBy(*keys, "block").orderBy("value")
    entry = lambda d, n, at: F.struct(d.alias("d"), n.alias("n"), at.alias("at"))
    near = [entry((F.col("n") * 0).cast("double"), F.col("n") - 1, F.col("value"))]
    for step in range(1, k + 1):
        for side in (F.lag, F.lead):
            other, many = side("value", step).over(order), side("n", step).over(order)
            near.append(entry(F.abs(F.col("value") - other), many, other))
    ordered = F.sort_array(F.filter(F.array(*near), lambda e: e["d"].isNotNull()))
    wanted = F.least(F.lit(k), F.col("all_n") - 1)
    # Walk outwards until enough rows are met, and keep the distance of the last step.
    walk = F.aggregate(
        ordered,
        entry(F.lit(0.0), F.lit(0).cast("long"), F.lit(None).cast("double")),
        lambda a, e: entry(
            F.when(a["n"] >= wanted, a["d"]).otherwise(e["d"]),
            a["n"] + e["n"],
            F.when(a["n"] >= wanted, a["at"]).otherwise(e["at"]),
        ),
    )
    return (
        copies.select(*keys, "value", "n", "all_n", "home", "block", walk.alias("_w"))
        .where("home = block and all_n > 1")
        .select(*keys, "value", "n", "all_n", F.col("_w.d").alias("radius"), F.col("_w.at").alias("at"))
    )


def neighbour_information(
    frame: DataFrame, columns: Sequence[str], target: str, k: int = 3
) -> DataFrame:
    """Mutual information of numeric columns with the target by nearest neighbours (Ross 2014).

    The k-th nearest row of the same class sets a radius; the rows of any class closer than that
    are counted. A value repeated more than k times has radius 0: then all its repeats count on both
    sides (Gao et al. 2017), where adding noise would give the same on average. Missing numbers take
    the median. Distances and counts come from counted values and running totals, so no rows are
    paired with each other.
    """
    labelled = frame.where(F.col(target).isNotNull())
    medians = quantile_row(labelled, columns, [0.5])
    filled = attach(labelled, medians, name="_m").select(
        F.col(target).cast("long").alias("class"),
        *[F.coalesce(F.col(c).cast("double"), F.get(f"_m.{c}", F.lit(0))).alias(c) for c in columns],
    )
    counted = count_values(long_form(filled, columns, keep=["class"]), ["feature", "class"], "value")
    near = _class_neighbours(counted, k)
    # The neighbour's own value is the limit on its side, free of rounding.
    v, at, radius = F.col("value"), F.col("at"), F.col("radius")
    inner = near.where("radius > 0").select(
        "feature",
        "class",
        "value",
        F.when(at < v, at).otherwise(v - radius).alias("low"),
        F.when(at > v, at).otherwise(v + radius).alias("high"),
    )
    # How many rows lie below a limit: limits enter the order as values that no row has.
    limits = inner.select("feature", F.explode(F.array("low", "high")).alias("value"))
    marks = limits.withColumn("n", F.lit(0).cast("long")).unionByName(
        counted.select("feature", "value", "n")
    )
    merged = marks.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    ranked = running_totals(merged, ["feature"], "value", ["n"]).select(
        "feature", "value", "n", "before_n"
    )
    lows = ranked.select(
        "feature", F.col("value").alias("low"), (F.col("before_n") + F.col("n")).alias("up_to")
    )
    highs = ranked.select("feature", F.col("value").alias("high"), F.col("before_n").alias("below"))
    within = (
        inner.join(lows, ["feature", "low"])
        .join(highs, ["feature", "high"])
        .select("feature", "class", "value", (F.col("below") - F.col("up_to")).alias("within"))
    )
    same = counted.groupBy("feature", "value").agg(F.sum("n").alias("repeats"))
    points = near.join(within, ["feature", "class", "value"], "left").join(
        same, ["feature", "value"]
    )
    tied = F.col("radius") == 0
    own = F.when(tied, F.col("n") - 1).otherwise(F.least(F.lit(k), F.col("all_n") - 1))
    around = F.when(tied, F.col("repeats")).otherwise(F.col("within"))
    part = _digamma(own) - _digamma(F.col("all_n")) - _digamma(F.greatest(around, F.lit(1)))
    sums = points.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * part).alias("parts")
    )
    return sums.select(
        "feature",
        F.greatest(_digamma(F.col("rows")) + F.col("parts") / F.col("rows"), F.lit(0.0)).alias(
            "mutual_info"
        ),
    )
