"""Saved models, metrics, and the index of training runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.attach import attach

ID_LENGTH = 12
RUN_SCHEMA = (
    "run_id string, created_at timestamp, model_name string, average_precision double, "
    "roc_auc double, feature_count long, threshold double, manifest string"
)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """One row of measures as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def run_id(inputs: Mapping) -> str:
    """A name fixed by what defines the model: data, parameters, features, threshold, options.

    Time, code version and library versions are left out, so the same inputs give the same name
    anywhere. The order of the features does not matter.
    """
    ordered = {**inputs, "features": sorted(inputs.get("features", []))}
    text = json.dumps(ordered, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:ID_LENGTH]


def manifest(
    model_name: str,
    params: Mapping,
    features: Sequence[str],
    threshold: float,
    options: Mapping,
    knobs: Mapping,
    data_sha256: str,
) -> dict:
    inputs = {
        "model_name": model_name,
        "params": dict(params),
        "features": list(features),
        "threshold": threshold,
        "options": dict(options),
        "knobs": dict(knobs),
        "data": data_sha256,
    }
    return {"run_id": run_id(inputs), **inputs}


def record_run(spark: SparkSession, described: Mapping, metrics: Mapping, index: str) -> None:
    """Append a run; a run recorded again replaces its older entry when the index is read."""
    row = (
        described["run_id"],
        described["model_name"],
        float(metrics["average_precision"]),
        float(metrics["roc_auc"]),
        len(described["features"]),
        float(described["threshold"]),
        json.dumps(described, sort_keys=True, default=str),
    )
    columns = RUN_SCHEMA.replace("created_at timestamp, ", "")
    entry = spark.createDataFrame([row], columns).withColumn("created_at", F.current_timestamp())
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    entry.select(*names).coalesce(1).write.mode("append").parquet(index)


def run_index(entries: DataFrame) -> DataFrame:
    """The newest entry of each run; the newest run of all is the current one."""
    newest = F.max_by(F.struct(*entries.columns), F.col("created_at")).alias("_e")
    runs = entries.groupBy("run_id").agg(newest).select("_e.*")
    latest = runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("current"))
    return attach(runs, latest).select(
        *entries.columns, (F.col("run_id") == F.col("_s.current")).alias("is_current")
    )
