"""Learned preprocessing as ``pyspark.ml`` stages.

The fitted stages are built-in ones (SQL expressions, indexers, encoders), so a fitted pipeline is
saved and loaded by Spark itself and scores inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.functions.attach import attach
from adjudica.functions.ordering import quantile_row
from adjudica.spec import KNOBS

MISSING_CATEGORY = "Missing"
FILLED, SCALED, TEXT, INDEX, HOT = "__filled", "__scaled", "__text", "__index", "__hot"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(value: float) -> str:
    """A double as a SQL literal that keeps every bit."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


class MedianScaler(Estimator):
    """Fill missing numbers with the exact median, then scale to mean 0 and population deviation 1.

    Fitting gives a ``SQLTransformer`` that adds ``<c>__filled`` and ``<c>__scaled``.
    """

    def __init__(self, columns: Sequence[str]) -> None:
        super().__init__()
        self.columns = list(columns)

    def statistics(self, frame: DataFrame) -> dict[str, tuple[float, float, float]]:
        """Median, and mean and deviation after filling, of each column."""
        moments = frame.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[
                F.struct(
                    F.count(c).alias("n"),
                    F.avg(F.col(c).cast("double")).alias("mean"),
                    F.var_pop(F.col(c).cast("double")).alias("var"),
                ).alias(c)
                for c in self.columns
            ],
        )
        medians = quantile_row(frame, self.columns, [0.5])
        row = attach(moments, medians, name="_m").first()
        found = {}
        for c in self.columns:
            rows, present, filled = row["_rows"], row[c]["n"], row["_m"][c]
            if not present:
                found[c] = (0.0, 0.0, 1.0)
                continue
            median, mean, var = float(filled[0]), row[c]["mean"], row[c]["var"]
            blank = rows - present
            whole = (present * mean + blank * median) / rows
            spread = present * (var + (mean - whole) ** 2) + blank * (median - whole) ** 2
            found[c] = (median, whole, (spread / rows) ** 0.5 or 1.0)
        return found

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        found = self.statistics(dataset)
        filled = ", ".join(
            f"coalesce(CAST({quoted(c)} AS DOUBLE), {number(m)}) AS {quoted(c + FILLED)}"
            for c, (m, _, _) in found.items()
        )
        scaled = ", ".join(
            f"({quoted(c + FILLED)} - {number(mean)}) / {number(std)} AS {quoted(c + SCALED)}"
            for c, (_, mean, std) in found.items()
        )
        return SQLTransformer(
            statement=f"SELECT *, {scaled} FROM (SELECT *, {filled} FROM __THIS__)"
        )


def category_stages(columns: Sequence[str]) -> list:
    """Missing becomes a category; an unseen category becomes all zeros; no level is dropped."""
    texts = ", ".join(
        f"coalesce({quoted(c)}, '{MISSING_CATEGORY}') AS {quoted(c + TEXT)}" for c in columns
    )
    return [
        SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__"),
        StringIndexer(
            inputCols=[c + TEXT for c in columns],
            outputCols=[c + INDEX for c in columns],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        # 'keep' adds a last index for unseen values, and dropLast drops exactly that one.
        OneHotEncoder(
            inputCols=[c + INDEX for c in columns],
            outputCols=[c + HOT for c in columns],
            dropLast=True,
        ),
    ]


def preprocessor(
    numeric: Sequence[str],
    categorical: Sequence[str],
    bottleneck: int | None = None,
    output: str = "features",
    network_steps: int = KNOBS.network_steps,
) -> Pipeline:
    """Numeric and categorical branches assembled into one vector; an empty branch is left out.

    With ``bottleneck`` an embedding of the numeric columns is added beside them, from a network
    trained for at most ``network_steps`` steps.
    """
    stages: list = []
    inputs: list[str] = []
    if numeric:
        stages.append(MedianScaler(numeric))
        inputs += [c + SCALED for c in numeric]
    if categorical:
        stages += category_stages(categorical)
        inputs += [c + HOT for c in categorical]
    if bottleneck and numeric:
        from adjudica.operators.autoencoder import Autoencoder

        coder = Autoencoder([c + SCALED for c in numeric], bottleneck, steps=network_steps)
        stages.append(coder)
        inputs += coder.names
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return Pipeline(stages=stages)


def encoded_names(model: PipelineModel) -> list[tuple[str, str]]:
    """(encoded name, source column) of each slot of the feature vector, in slot order."""
    labels: dict[str, list[str]] = {}
    assembled: list[str] = []
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            for column, found in zip(stage.getInputCols(), stage.labelsArray):
                labels[column.removesuffix(TEXT)] = list(found)
        elif isinstance(stage, VectorAssembler):
            assembled = stage.getInputCols()
    names: list[tuple[str, str]] = []
    for column in assembled:
        if column.endswith(HOT):
            source = column.removesuffix(HOT)
            names += [(f"{source}_{level}", source) for level in labels[source]]
        else:
            source = column.removesuffix(SCALED)
            names.append((source, source))
    return names
