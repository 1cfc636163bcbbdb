"""Preparing stored tables and keeping a record of how each was made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators.features import engineer
from adjudica.operators.quality import repair_impossible
from adjudica.sources.fingerprints import file_fingerprints, table_fingerprint
from adjudica.sources.tables import read_table, write_parquet
from adjudica.spec import APPLICANTS, ENGINEERED_CATEGORICAL, ENGINEERED_NUMERIC, TableSpec

def record_stage(
    frame: DataFrame, stage: str, path: str, log: str, derived: Sequence[str] = ()
) -> None:
    """Append one row about a stored table; earlier rows, of any stage, stay."""
    entry = table_fingerprint(frame).select(
        F.lit(stage).alias("stage"),
        F.lit(path).alias("path"),
        "sha256",
        F.col("rows").alias("n_rows"),
        F.lit(len(frame.columns)).cast("long").alias("n_columns"),
        F.array(*[F.lit(d) for d in derived]).cast("array<string>").alias("derived"),
        F.current_timestamp().alias("recorded_at"),
    )
    entry.coalesce(1).write.mode("append").parquet(log)


def record_files(spark: SparkSession, stage: str, path: str, log: str) -> None:
    """Append the fingerprint of the files of a raw source."""
    files = file_fingerprints(spark, path)
    parts = F.sort_array(F.collect_list("sha256"))
    files.agg(
        F.lit(stage).alias("stage"),
        F.lit(path).alias("path"),
        F.sha2(F.array_join(parts, ","), 256).alias("sha256"),
        F.lit(None).cast("long").alias("n_rows"),
        F.lit(None).cast("long").alias("n_columns"),
        F.array().cast("array<string>").alias("derived"),
        F.current_timestamp().alias("recorded_at"),
    ).coalesce(1).write.mode("append").parquet(log)


def latest_stages(spark: SparkSession, log: str) -> DataFrame:
    """The newest record of each stage."""
    entries = spark.read.parquet(log)
    newest = F.max_by(F.struct(*entries.columns), F.col("recorded_at")).alias("_e")
    return entries.groupBy("stage").agg(newest).select("_e.*")


def prepare(
    spark: SparkSession, raw: str, output: str, log: str, spec: TableSpec = APPLICANTS
) -> DataFrame:
    """Raw file → repaired, typed table, with records of both."""
    write_parquet(repair_impossible(read_table(spark, raw, spec), spec.nonnegative), output)
    stored = read_table(spark, output, spec)
    record_files(spark, "raw", raw, log)
    record_stage(stored, "processed", output, log)
    return stored


def preprocess(frame: DataFrame, output: str, log: str) -> DataFrame:
    """Stored table with the engineered columns. Nulls stay: filling them is learned per fold."""
    write_parquet(engineer(frame), output)
    stored = frame.sparkSession.read.parquet(output)
    record_stage(
        stored, "preprocessed", output, log, [*ENGINEERED_NUMERIC, *ENGINEERED_CATEGORICAL]
    )
    return stored
