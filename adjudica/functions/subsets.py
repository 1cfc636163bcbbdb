"""Statistics of many overlapping subsets of a table from one grouping of it.

Every row lies in one numbered cell, and a subset is a set of cells: the training rows of a fold are all
cells but the fold's. Counts and moments are gathered per cell and added up; medians, which do not
add up, come from one tally of the values near the middle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.ordering import ACCURACY, MARGIN, WHOLE

Subset = frozenset[int]


def cell_moments(frame: DataFrame, cell: str, columns: Sequence[str]) -> dict[int, np.ndarray]:
    """Per cell an array of (count, mean, population variance) per column; one row per cell moves."""
    parts = [
        F.array(F.count(x).cast("double"), F.coalesce(F.avg(x), F.lit(0.0)), F.coalesce(F.var_pop(x), F.lit(0.0))).alias(f"m{k}")
        for k, x in enumerate(F.col(c).cast("double") for c in columns)
    ]
    if not parts:
        return {r[0]: np.zeros((0, 3)) for r in frame.select(cell).distinct().collect()}
    rows = frame.groupBy(cell).agg(*parts).collect()
    return {r[0]: np.array([r[k + 1] for k in range(len(columns))]) for r in rows}


def added_moments(parts: Sequence[np.ndarray]) -> np.ndarray:
    """(count, mean, population variance) of the union of disjoint parts, column by column."""
    stack = np.array(parts)
    count = stack[:, :, 0].sum(axis=0)
    safe = np.maximum(count, 1.0)
    mean = (stack[:, :, 0] * stack[:, :, 1]).sum(axis=0) / safe
    inner = stack[:, :, 0] * (stack[:, :, 2] + (stack[:, :, 1] - mean) ** 2)
    return np.stack([count, mean, inner.sum(axis=0) / safe], axis=1)


def subset_medians(
    frame: DataFrame,
    cell: str,
    columns: Sequence[str],
    subsets: Sequence[Subset],
    moments: dict[int, np.ndarray],
) -> np.ndarray:
    """Exact median of each column in each subset; NaN where a subset has no value.

    Subsets of one random split have medians close to that of the whole table, so one bracket per column
    serves them all. Its width follows the smallest subset; if a median still lies outside, the brackets
    become four times as wide and the tally is taken again, at last over all values.
    """
    size = (len(subsets), len(columns))
    counts = np.zeros(size)
    for i, subset in enumerate(subsets):
        for c in subset:
            if c in moments:
                counts[i] += moments[c][:, 0]
    found = np.full(size, np.nan)
    if not columns or not counts.any():
        return found
    rows = sum(float(m[:, 0].max(initial=0.0)) for m in moments.values())
    reach = MARGIN + 2.0 / math.sqrt(counts[counts > 0].min())
    numbers = [F.col(c).cast("double") for c in columns]
    while True:
        whole = rows < WHOLE or reach >= 0.5
        ends = [None] * len(columns)
        if not whole:
            points = f"array({0.5 - reach!r}D, {0.5 + reach!r}D)"
            named = frame.select(*[x.alias(f"e{k}") for k, x in enumerate(numbers)])
            ends = named.agg(*[F.expr(f"percentile_approx(e{k}, {points}, {ACCURACY})") for k in range(len(columns))]).first()
        low, high = _middle(frame, cell, numbers, ends, subsets, counts)
        missing = (counts > 0) & (np.isnan(low) | np.isnan(high))
        if not missing.any():
            return np.where(counts > 0, (low + high) / 2.0, np.nan)
        if whole:
            raise AssertionError("a tally of all values holds every median")
        reach *= 4.0


def _middle(frame, cell, numbers, ends, subsets, counts) -> tuple[np.ndarray, np.ndarray]:
    """The two middle values of each subset and column, NaN where a bracket does not hold them."""
    entries = []
    for k, x in enumerate(numbers):
        at = F.lit(k).alias("k")
        inside = F.struct(at, x.alias("value"))
        if ends[k] is None:
            entries.append(F.when(x.isNotNull(), inside))
        else:
            below = F.struct(at, F.lit(None).cast("double").alias("value"))
            entries.append(F.when(x < ends[k][0], below).when(x <= ends[k][1], inside))
    tally = (
        frame.select(F.col(cell).alias("cell"), F.explode(F.array(*entries)).alias("c")).where("c is not null")
        .groupBy("cell", "c.k", "c.value").agg(F.count(F.lit(1)).alias("n"))
    )
    spark = frame.sparkSession
    of_cell = [(c, i) for i, subset in enumerate(subsets) for c in sorted(subset)]
    members = F.broadcast(spark.createDataFrame(of_cell, "cell int, subset int"))  # cells × subsets
    sizes = [(i, k, int(n)) for (i, k), n in np.ndenumerate(counts) if n]
    sizes = F.broadcast(spark.createDataFrame(sizes, "subset int, k int, total long"))
    added = tally.join(members, "cell").groupBy("subset", "k", "value").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy("subset", "k").orderBy(F.asc_nulls_first("value")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = added.withColumn("last", F.sum("n").over(so_far)).join(sizes, ["subset", "k"])
    here = lambda at: F.max(F.when((F.col("last") - F.col("n") <= at) & (at < F.col("last")), F.col("value")))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    out = np.full((2, *counts.shape), np.nan)
    for r in placed.groupBy("subset", "k").agg(here(low).alias("low"), here(high).alias("high")).collect():
        for side, name in enumerate(("low", "high")):
            if r[name] is not None:
                out[side, r["subset"], r["k"]] = r[name]
    return out[0], out[1]


def cell_levels(frame: DataFrame, cell: str, columns: Sequence[str], missing: str) -> dict[str, dict[int, set[str]]]:
    """Per categorical column and cell the values that occur, ``missing`` for null: as many as a model has slots."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("level")) for c in columns])
    found: dict[str, dict[int, set[str]]] = {c: {} for c in columns}
    for r in frame.select(F.col(cell).alias("cell"), F.inline(pairs)).distinct().collect():
        found[r["feature"]].setdefault(r["cell"], set()).add(r["level"])
    return found
