"""Exact running sums, ranks and quantiles without a window over the whole table.

A window ordered over a whole table runs in one task. Here equal values are counted first, the
distinct values are cut into buckets of about equal size, every bucket gets the total of the
buckets before it, and the ordered window runs inside a bucket. A value that holds a third of all
rows is one row after counting. The cut points only balance the work: any cut points give the same
result, so an approximate sketch is enough to choose them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.attach import attach

#: Sketches of quantile brackets: their accuracy, and how far a bracket reaches in shares of the rows.
ACCURACY = 10_000
MARGIN = 4.0 / ACCURACY
#: Columns with fewer values are taken whole, as a share of them may be less than one row.
WHOLE = 20_000


def count_values(frame: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """Each distinct (keys, value) once, with its number of rows ``n`` and the given sums."""
    return (
        frame.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(a) for a, c in sums.items()])
    )


def _span(frame: DataFrame) -> int:
    """Side of the square number of buckets: about two per shuffle partition, at least 64."""
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(64, max(8, math.isqrt(2 * partitions) + 1))


def _with_bucket(frame: DataFrame, value: str, cuts: DataFrame, keys: list[str], span: int):
    """Add ``_bucket``, the number of cut points below the value, by two short searches."""
    coarse = F.expr(f"transform(sequence(1, {span - 1}), i -> get(cuts, i * {span} - 1))")
    found = attach(frame, cuts.select(*keys, "cuts", coarse.alias("coarse")), keys, "_cuts")
    kept = frame.columns
    step = F.expr(f"{span} * size(filter(_cuts.coarse, c -> c < `{value}`))")
    rest = F.expr(f"_step + size(filter(slice(_cuts.cuts, _step + 1, {span}), c -> c < `{value}`))")
    return found.select(*kept, "_cuts", step.alias("_step")).select(*kept, rest.alias("_bucket"))


def _known(counts: Sequence[str]) -> str:
    """A condition that always holds and reads all of the counts."""
    return " and ".join(f"`{c}` >= 0" for c in dict.fromkeys(counts))


def running_totals(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    totals: Sequence[str],
    descending: bool = False,
    also: Sequence[str] = (),
) -> DataFrame:
    """Add ``before_<t>``, the sum of t over the values ahead of this one, and ``all_<t>``.

    ``counted`` holds each (keys, value) once, the totals are never null, and ``keys`` name
    features, classes or folds, so they take few values. ``also`` names further counts of
    ``counted`` that the caller reads elsewhere: every branch of this plan then asks for the same
    columns, and Spark reuses one shuffle for all of them.
    """
    keys, span = list(keys), _span(counted)
    buckets = span * span
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    known = _known([*totals, *also])
    shares = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    sketch = f"percentile_approx(if({known}, `{value}`, null), array({shares}), {10 * buckets})"
    cuts = counted.groupBy(*keys).agg(F.expr(sketch).alias("cuts"))
    placed = _with_bucket(counted, value, cuts, keys, span)

    # At most span² rows per key: this window and this broadcast do not grow with the table.
    sums = placed.groupBy(*keys, "_bucket").agg(
        *[F.expr(f"sum(if({known}, `{t}`, 0))").alias(t) for t in totals]
    )
    ahead = Window.partitionBy(*keys).orderBy(order("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(f"_ahead_{t}") for t in totals],
        *[F.sum(t).over(Window.partitionBy(*keys)).alias(f"all_{t}") for t in totals],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order(value)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = placed.join(F.broadcast(offsets), [*keys, "_bucket"])
    return joined.select(
        *counted.columns,
        *[
            (F.col(f"_ahead_{t}") + F.coalesce(F.sum(t).over(inside), F.lit(0))).alias(f"before_{t}")
            for t in totals
        ],
        *[f"all_{t}" for t in totals],
    )


def order_statistics(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: dict[str, Callable[[Column], Column]],
    also: Sequence[str] = (),
) -> DataFrame:
    """Values at 0-based positions of the sorted rows; a position is a function of the row count."""
    placed = running_totals(counted, keys, value, ["n"], also=also)
    total, first, last = F.col("all_n"), F.col("before_n"), F.col("before_n") + F.col("n")
    known = F.expr(_known(["n", *also]))
    picks = [
        F.max(F.when(known & (first <= at(total)) & (at(total) < last), F.col(value))).alias(name)
        for name, at in positions.items()
    ]
    return placed.groupBy(*keys).agg(F.max("all_n").alias("n"), *picks)


def grouped_quantiles(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Sequence[float],
    also: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles ``q0, q1, …`` with linear interpolation, one row per key."""
    positions: dict[str, Callable[[Column], Column]] = {}
    for i, share in enumerate(shares):
        spot = lambda total, s=share: (total - 1) * F.lit(float(s))
        positions[f"_lo{i}"] = lambda total, s=spot: F.floor(s(total))
        positions[f"_hi{i}"] = lambda total, s=spot: F.least(F.floor(s(total)) + 1, total - 1)
    picked = order_statistics(counted, keys, value, positions, also)
    columns = []
    for i, share in enumerate(shares):
        spot = (F.col("n") - 1) * F.lit(float(share))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        columns.append((low + (high - low) * (spot - F.floor(spot))).alias(f"q{i}"))
    return picked.select(*keys, "n", *columns)


def quantile_row(
    frame: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
) -> DataFrame:
    """One row with an array of exact quantiles per column, by the same steps at every size."""
    return bracketed_quantiles(frame, {c: F.col(c) for c in columns}, shares)


def bracketed_quantiles(
    frame: DataFrame, entries: Mapping[str, Column], shares: Sequence[float]
) -> DataFrame:
    """One row with an array of exact quantiles per entry, linear between neighbours; null without values.

    An entry is any numeric expression, for example a column where a condition holds, so that one call
    serves many subsets. The first scan sketches every entry, and the sketch's bounded error gives each
    wanted position a bracket that must hold it. The second scan counts the rows below each bracket and
    the values inside; about one row in a thousand is inside, and only counts of these move. A
    bracket that does not hold its position stops the query.
    """
    names, shares = list(entries), [float(s) for s in shares]
    values = frame.select(*[entries[name].cast("double").alias(f"e{k}") for k, name in enumerate(names)])
    ends = [min(max(s + side * MARGIN, 0.0), 1.0) for s in shares for side in (-1.0, 1.0)]
    points = ", ".join(f"{p!r}D" for p in ends)
    sketch = lambda k: F.expr(f"percentile_approx(e{k}, array({points}), {ACCURACY})")
    brackets = values.agg(
        *[F.struct(F.count(f"e{k}").alias("n"), sketch(k).alias("at")).alias(f"b{k}") for k in range(len(names))]
    )
    cells = []
    for k in range(len(names)):
        value = F.col(f"e{k}")
        for i, share in enumerate(shares):
            many = F.col(f"_s.b{k}.n") >= WHOLE
            low, high = (F.when(many, F.get(F.col(f"_s.b{k}.at"), F.lit(2 * i + side))) for side in (0, 1))
            which = F.lit(k * len(shares) + i)
            below = value < low if ends[2 * i] > 0.0 else F.lit(False)
            inside = F.coalesce(value <= high, F.lit(True)) if ends[2 * i + 1] < 1.0 else F.lit(True)
            inside = inside & value.isNotNull()
            cells.append(
                F.when(below, F.struct(which.alias("which"), F.lit(None).cast("double").alias("value")))
                .when(inside, F.struct(which.alias("which"), value.alias("value")))
            )
    tally = (
        attach(values, brackets).select(F.explode(F.array(*cells)).alias("c")).where("c is not null")
        .groupBy("c.which", "c.value").agg(F.count(F.lit(1)).alias("n"))
    )
    # The rows below a bracket are one row without a value, which comes first.
    so_far = Window.partitionBy("which").orderBy(F.asc_nulls_first("value")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = attach(tally.withColumn("last", F.sum("n").over(so_far)), brackets)
    total = F.element_at(
        F.array(*[F.col(f"_s.b{k}.n") for k in range(len(names))]), F.floor(F.col("which") / len(shares)).cast("int") + 1
    )
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("which") % len(shares) + 1)
    spots = placed.select("which", "value", (F.col("last") - F.col("n")).alias("first"), "last", ((total - 1) * share).alias("spot"), total.alias("n"))
    low, high = F.floor("spot"), F.least(F.floor("spot") + 1, F.col("n") - 1)
    here = lambda at: F.max(F.when((F.col("first") <= at) & (at < F.col("last")), F.col("value")))
    picked = spots.groupBy("which").agg(
        here(low).alias("low"), here(high).alias("high"), F.max(F.col("spot") - F.floor("spot")).alias("part")
    )
    missed = F.raise_error(F.lit("a bracket of quantile_row does not hold its position")).cast("double")
    between = F.when(
        F.col("low").isNotNull() & F.col("high").isNotNull(), F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    ).otherwise(missed)
    at = lambda k, i: F.max(F.when(F.col("which") == k * len(shares) + i, F.col("q")))
    whole = picked.select("which", between.alias("q")).groupBy().agg(
        F.lit(None).cast("int").alias("_"),
        *[F.array(*[at(k, i) for i in range(len(shares))]).alias(f"q{k}") for k in range(len(names))],
    )
    return whole.select(*[F.when(F.get(f"q{k}", F.lit(0)).isNotNull(), F.col(f"q{k}")).alias(name) for k, name in enumerate(names)])
