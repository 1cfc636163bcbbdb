"""Scoring a stream of new rows with the same code as a batch.

Every step is row-wise, so there is no state to keep and no watermark to set.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from adjudica.operators.classifiers import predict
from adjudica.operators.features import engineer
from adjudica.sources.tables import project_features
from adjudica.spec import APPLICANTS, KNOBS, TableSpec


def feature_schema(spec: TableSpec) -> T.StructType:
    types = spec.types()
    return T.StructType([T.StructField(c, types[c]) for c in (spec.key, *spec.features)])


def read_stream(spark: SparkSession, folder: str, spec: TableSpec = APPLICANTS) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(feature_schema(spec)).parquet(folder)


def score_stream(
    rows: DataFrame,
    model: PipelineModel,
    threshold: float = KNOBS.threshold,
    spec: TableSpec = APPLICANTS,
) -> DataFrame:
    return predict(model, engineer(project_features(rows, spec)), threshold)


def write_scores(
    scored: DataFrame, output: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append scores as parquet, each input file exactly once."""
    writer = scored.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)
