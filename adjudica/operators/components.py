"""Principal components of the standardized columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.operators.preprocess import preprocessor


def pca_scree(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Explained variance share per component, and the running total."""
    prepared = preprocessor(columns, []).fit(frame).transform(frame)
    shares = (
        PCA(k=len(columns), inputCol="features", outputCol="pca").fit(prepared).explainedVariance
    )
    rows, total = [], 0.0
    for i, share in enumerate(shares.toArray()):
        total += float(share)
        rows.append((i + 1, float(share), total))
    return frame.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def pca_map(
    frame: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Each row's first two principal components over all standardized features."""
    encoded = preprocessor(numeric, categorical).fit(frame).transform(frame)
    scaler = StandardScaler(
        inputCol="features", outputCol="standard", withMean=True, withStd=True
    ).fit(encoded)
    standard = scaler.transform(encoded)
    mapped = PCA(k=2, inputCol="standard", outputCol="pca").fit(standard).transform(standard)
    place = vector_to_array("pca")
    return mapped.select(*keep, F.get(place, F.lit(0)).alias("x"), F.get(place, F.lit(1)).alias("y"))
