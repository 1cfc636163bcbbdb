"""Session settings and the shared folder that outlives a lost executor."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task of heavy work takes before a small table is spread.
SPREAD_ROWS = 5_000


def build_session(app: str = "adjudica", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the call site of every column expression slows down the building of plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session, where driver and executors are one process, may fall back to a temporary
    folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="adjudica-")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/adjudica/{label}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, label: str = "table", **options) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back.

    Repeated fits then start from a file that survives executor loss instead of recomputing the
    joins behind the frame. ``options`` are those of the writer.
    """
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """``frame`` in a partition per ``SPREAD_ROWS`` rows, at most one per core, if it has fewer.

    A small stored table is one file and so one task, which is too few for work that is heavy per row.
    Large tables have more partitions than that and stay as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    now = frame.rdd.getNumPartitions()
    if now >= cores:
        return frame
    wanted = min(cores, math.ceil((frame.count() if rows is None else rows) / SPREAD_ROWS))
    return frame.repartition(wanted) if wanted > now else frame
