"""Content fingerprints of tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_fingerprint(frame: DataFrame) -> DataFrame:
    """One row: sha256 over row count and hash sums, independent of row order.

    Sums of two hashes per row keep track of repeated rows, which an exclusive or would cancel, and
    add up in each task before anything is shuffled.
    """
    columns = [F.col(c) for c in sorted(frame.columns)]
    wide = "decimal(38,0)"
    sums = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*columns).cast(wide)).alias("a"),
        F.sum(F.xxhash64(F.lit(1), *columns).cast(wide)).alias("b"),
    )
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("rows", "a", "b")])
    names = ",".join(sorted(frame.columns))
    return sums.select("rows", F.sha2(F.concat_ws("|", text, F.lit(names)), 256).alias("sha256"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of the bytes of every file below a path, one task per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
