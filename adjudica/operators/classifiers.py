"""The registered classifiers, their defaults and the spaces they are tuned over."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.operators.binned_trees import can_fit, fit_binned
from adjudica.operators.preprocess import encoded_names, preprocessor
from adjudica.session import spread
from adjudica.spec import KNOBS

WEIGHT, CENTRED = "__class_weight", "__centred"
#: Rows up to which ``pyspark.ml`` grows boosted trees itself.
SCANNED_ROWS = 2_000_000


class UnknownModelError(ValueError):
    def __init__(self, name: str) -> None:
        super().__init__(f"no model is named {name!r}; there are {', '.join(sorted(MODELS))}")


@dataclass(frozen=True)
class Range:
    """Where one parameter is drawn from."""

    low: float
    high: float
    kind: str = "float"  # float, log or int
    step: int = 1

    def draw(self, source: random.Random) -> float | int:
        if self.kind == "log":
            return math.exp(source.uniform(math.log(self.low), math.log(self.high)))
        if self.kind == "int":
            return int(source.randrange(int(self.low), int(self.high) + 1, self.step))
        return source.uniform(self.low, self.high)


@dataclass(frozen=True)
class ModelKind:
    """How a classifier is built from parameters and the number of training rows."""

    name: str
    build: Callable[[Mapping[str, float], int], Estimator]
    space: Mapping[str, Range]

    def estimator(self, params: Mapping[str, float] | None, rows: int) -> Estimator:
        built = self.build(dict(params or {}), rows)
        if not isinstance(built, Estimator) or not built.hasParam("probabilityCol"):
            raise TypeError(f"model {self.name!r} must be an estimator that gives probabilities")
        return built


def _logistic(params, rows):
    # The penalty of one observation against the summed loss becomes one of the mean loss.
    strength = params.pop("C", 1.0)
    settings = {"maxIter": 1000, "tol": 1e-4, "elasticNetParam": 0.0, "standardization": False, **params}
    return LogisticRegression(regParam=1.0 / (strength * max(rows, 1)), **settings)


def _forest(params, rows):
    settings = {"numTrees": 300, "maxDepth": 10, "seed": KNOBS.seed, **params}
    settings["featureSubsetStrategy"] = str(settings.get("featureSubsetStrategy", "sqrt"))
    return RandomForestClassifier(**settings)


def _boosting(params, rows):
    settings = {
        "maxIter": 100,
        "stepSize": 0.1,
        "maxDepth": 5,
        "minInstancesPerNode": 20,
        "maxBins": 64,
        "seed": KNOBS.seed,
        **params,
    }
    return GBTClassifier(**settings)


def _sampled_boosting(params, rows):
    settings = {
        "maxIter": 100,
        "stepSize": 0.1,
        "maxDepth": 5,
        "minInstancesPerNode": 20,
        "maxBins": 128,
        "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
        "seed": KNOBS.seed,
        **params,
    }
    settings["featureSubsetStrategy"] = str(settings["featureSubsetStrategy"])
    return GBTClassifier(**settings)


# Search ranges.
_KINDS = (
    ModelKind("logistic_regression", _logistic, {"C": Range(1e-3, 1e2, "log")}),
    ModelKind(
        "random_forest",
        _forest,
        {
            "numTrees": Range(100, 600, "int", 50),
            "maxDepth": Range(3, 20, "int"),
            "minInstancesPerNode": Range(1, 20, "int"),
            "featureSubsetStrategy": Range(0.3, 1.0),
        },
    ),
    ModelKind(
        "gradient_boosting",
        _boosting,
        {
            "stepSize": Range(0.01, 0.3, "log"),
            "maxIter": Range(100, 500, "int", 50),
            "maxDepth": Range(4, 6, "int"),
            "minInstancesPerNode": Range(5, 50, "int"),
        },
    ),
    ModelKind(
        "sampled_boosting",
        _sampled_boosting,
        {
            "maxIter": Range(100, 800, "int", 50),
            "stepSize": Range(0.01, 0.3, "log"),
            "maxDepth": Range(3, 12, "int"),
            "minInstancesPerNode": Range(5, 60, "int"),
            "subsamplingRate": Range(0.6, 1.0),
            "featureSubsetStrategy": Range(0.6, 1.0),
        },
    ),
)
MODELS: dict[str, ModelKind] = {kind.name: kind for kind in _KINDS}
DEFAULT_MODEL = "sampled_boosting"


def get_model(name: str) -> ModelKind:
    if name not in MODELS:
        raise UnknownModelError(name)
    return MODELS[name]


def balanced_weight(counts: Mapping[int, int], target: str):
    """The weight column for known class counts."""
    total = sum(counts.values())
    column = None
    for label, n in counts.items():
        weight = F.lit(total / (len(counts) * n))
        column = (
            F.when(F.col(target) == label, weight)
            if column is None
            else column.when(F.col(target) == label, weight)
        )
    return column


def fit_model(
    train: DataFrame,
    target: str,
    numeric,
    categorical,
    name: str = DEFAULT_MODEL,
    params: Mapping[str, float] | None = None,
    bottleneck: int | None = None,
    network_steps: int = KNOBS.network_steps,
) -> PipelineModel:
    """Fit preprocessing and classifier on the training rows alone.

    Class weights, medians, encoders and the classifier all come from ``train``, so a fold's fit
    never sees the rows it is later scored on. A linear model keeps the means of its inputs, from which
    its explanations start; scoring does not compute that column. The boosted trees of a large table are grown
    from stored bins.
    """
    kind = get_model(name)
    used = train.select(target, *numeric, *categorical).where(F.col(target).isNotNull())
    counts = {r[0]: r[1] for r in used.groupBy(target).count().collect()}
    rows = sum(counts.values())
    classifier = kind.estimator(params, rows)
    if not isinstance(classifier, LogisticRegression):
        used = spread(used, rows)  # trees read their rows hundreds of times
    weighted = used.withColumn(WEIGHT, balanced_weight(counts, target))
    classifier.setLabelCol(target).setFeaturesCol("features").setWeightCol(WEIGHT)
    prepared = preprocessor(
        list(numeric), list(categorical), bottleneck, network_steps=network_steps
    )
    if rows > SCANNED_ROWS and can_fit(classifier, counts):
        ready = prepared.fit(weighted)
        weights = {label: rows / (len(counts) * n) for label, n in counts.items()}
        boosted = fit_binned(ready.transform(weighted), classifier, counts, weights, _hot_slots(ready, categorical))
        return PipelineModel([*ready.stages, boosted])
    stages = [*prepared.getStages(), classifier]
    if isinstance(classifier, LogisticRegression):
        means = StandardScaler(inputCol="features", outputCol=CENTRED, withMean=True, withStd=False)
        stages.insert(-1, means)
    return Pipeline(stages=stages).fit(weighted)


def _hot_slots(ready: PipelineModel, categorical) -> list[tuple[int, int]]:
    """First slot and number of slots of each category in the feature vector."""
    sources = [source for _, source in encoded_names(ready)]
    return [(sources.index(c), sources.count(c)) for c in categorical]


def score_rows(model: PipelineModel, frame: DataFrame, p: str = "p") -> DataFrame:
    """The frame with the probability of class 1 beside its columns."""
    scored = model.transform(frame)
    return scored.select(*frame.columns, vector_to_array("probability").getItem(1).alias(p))


def predict(
    model: PipelineModel,
    frame: DataFrame,
    threshold: float = KNOBS.threshold,
    probability: str = "ApprovalProbability",
    decision: str = "LoanApprovedPrediction",
) -> DataFrame:
    """Probability and 0/1 decision beside the features; works on batch and streaming frames."""
    scored = score_rows(model, frame, probability)
    return scored.withColumn(decision, (F.col(probability) >= threshold).cast("long"))
