"""Counting and repairing impossible values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_impossible(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of negatives in each column that must not be negative."""
    return frame.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns if c in frame.columns])


def repair_impossible(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negatives become null, to be imputed later inside the model."""
    return frame.withColumns(
        {c: F.when(F.col(c) >= 0, F.col(c)) for c in columns if c in frame.columns}
    )
