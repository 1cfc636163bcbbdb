"""Adding small statistics to every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(frame: DataFrame, stats: DataFrame, keys: Sequence[str] = (), name: str = "_s") -> DataFrame:
    """Add ``stats`` to each row as the struct column ``name``.

    Without keys ``stats`` is the one row of a global aggregate and enters the plan as a scalar
    subquery. It is unpacked by ``explode`` because a plain column would be copied into every
    expression that uses it, and the subquery planned once per copy. With keys it holds one row per feature or class label, a number fixed by the table's
    columns and not by its rows, so it is broadcast.
    """
    if not keys:
        row = stats.select(F.struct("*").alias(name)).scalar()
        return frame.select("*", F.explode(F.array(row)).alias(name))
    packed = stats.select(
        *keys, F.struct(*[c for c in stats.columns if c not in keys]).alias(name)
    )
    return frame.join(F.broadcast(packed), list(keys), "left")


def long_form(
    frame: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    feature: str = "feature",
    value: str = "value",
    cast: str = "double",
) -> DataFrame:
    """One row per (row, column): the kept columns, the column's name and its value."""
    kept = [F.col(c) for c in keep]
    return frame.select(*kept, *[F.col(c).cast(cast).alias(c) for c in columns]).unpivot(
        list(keep), list(columns), feature, value
    )


def stacked(row: DataFrame, entries: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row frame into one row per entry."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(e, names)]) for e in entries]
    return row.select(F.inline(F.array(*structs)))
