"""The whole training run, its tables, and the chain of stages around it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators import errors, explain, metrics, tuning
from adjudica.operators.classifiers import DEFAULT_MODEL, predict, score_rows
from adjudica.operators.detectors import clean_training_rows
from adjudica.operators.features import engineer
from adjudica.operators.rankings import select_features
from adjudica.operators.selection import marked_curve
from adjudica.operators.splits import assign_folds, mark_holdout, split_holdout
from adjudica.operators.tree_contributions import explain_decisions, explain_model
from adjudica.operators.validation import (
    CalibratedModel,
    ModelPlan,
    calibrate,
    learning_curve,
    out_of_fold,
)
from adjudica.session import materialize
from adjudica.sources import catalog, runs, tables
from adjudica.sources.fingerprints import table_fingerprint
from adjudica.spec import APPLICANTS, ENGINEERED, KNOBS, Knobs, TableSpec

STAGES = ("prepare", "preprocess", "train", "evaluate")


@dataclass(frozen=True)
class TrainingOptions:
    tune: bool = False
    select_features: bool = False
    remove_outliers: bool = True
    trials: int = KNOBS.trials
    folds: int = KNOBS.folds
    params: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class TrainingOutcome:
    plan: ModelPlan
    model: PipelineModel
    calibrated: CalibratedModel
    metrics: dict
    threshold: float
    features: list[str]
    train: DataFrame
    holdout: DataFrame
    trials: DataFrame | None = None
    curve: DataFrame | None = None


def train_simple(
    frame: DataFrame,
    spec: TableSpec,
    name: str = DEFAULT_MODEL,
    params: Mapping[str, float] | None = None,
    threshold: float = KNOBS.threshold,
) -> tuple[PipelineModel, DataFrame]:
    """Split, fit and score in one call: the model and one row of holdout measures."""
    train, holdout = split_holdout(frame, spec)
    plan = ModelPlan(spec.target, tuple(spec.numeric), tuple(spec.categorical), name, params)
    model = plan.fit(materialize(train, "train"))
    return model, metrics.score_report(score_rows(model, holdout), threshold, spec.target)


def run_training(
    frame: DataFrame,
    name: str = DEFAULT_MODEL,
    options: TrainingOptions | None = None,
    spec: TableSpec = ENGINEERED,
    raw: TableSpec = APPLICANTS,
    knobs: Knobs = KNOBS,
) -> TrainingOutcome:
    """Clean, select, tune, fit and choose a threshold on the training rows; score the holdout once.

    ``frame`` is the repaired table. Its engineered columns are row-wise, so they are added before
    the split; everything learned comes after it.
    """
    options = options or TrainingOptions()
    marked = mark_holdout(engineer(frame), spec, knobs.holdout, knobs.seed)
    stored = materialize(assign_folds(marked, spec, options.folds, knobs.seed), "training")
    train = stored.where("not is_holdout").drop("is_holdout")
    holdout = stored.where("is_holdout").drop("is_holdout", "fold")

    removed = 0
    if options.remove_outliers:
        kept, voted = clean_training_rows(train, raw, knobs.contamination, knobs.votes)
        kept = materialize(kept, "cleaned")
        removed = voted.where("consensus").count()
        train = kept

    features, curve, trials = list(spec.candidates), None, None
    params = dict(options.params)
    if options.select_features:
        features, curve = select_features(train, spec, features, name, params, options.folds)
    numeric, categorical = spec.split_types(features)
    plan = ModelPlan(spec.target, tuple(numeric), tuple(categorical), name, params)
    if options.tune:
        trials = materialize(
            tuning.tune(train, plan, options.trials, options.folds, knobs.seed, params), "trials"
        )
        params = {**tuning.best_params(trials, name), **params}
        plan = ModelPlan(spec.target, tuple(numeric), tuple(categorical), name, params)

    model = plan.fit(train)
    held_out = out_of_fold(train, plan, options.folds)
    costs = (knobs.false_approval_cost, knobs.false_rejection_cost)
    threshold = metrics.best_threshold(metrics.cost_curve(held_out, *costs)).first()["threshold"]
    report = metrics.score_report(score_rows(model, holdout), threshold, spec.target)
    measured = report.first().asDict()
    calibrated = calibrate(train, plan, options.folds)
    smooth = metrics.threshold_metrics(calibrated.score(holdout), threshold, spec.target)
    measured["brier_score_calibrated"] = smooth.first()["brier_score"]
    measured["outliers_removed"] = removed
    measured["feature_count"] = len(features)
    return TrainingOutcome(
        plan, model, calibrated, measured, threshold, features, train, holdout, trials, curve
    )


def metrics_row(spark: SparkSession, measured: Mapping) -> DataFrame:
    """The measures of a run as a one-row frame."""
    return spark.createDataFrame([dict(measured)])


def figure_tables(
    outcome: TrainingOutcome,
    spec: TableSpec = ENGINEERED,
    segments=("EmploymentType", "credit_band"),
    folds: int = KNOBS.folds,
    sizes: int = 8,
) -> dict[str, DataFrame]:
    """The numbers behind every figure of a run, by name."""
    y = spec.target
    scored = materialize(score_rows(outcome.model, outcome.holdout), "scored")
    smooth = outcome.calibrated.score(outcome.holdout)
    classified = errors.classify(scored, outcome.threshold, y)
    long, _ = explain_model(outcome.model, outcome.holdout, spec.key)
    long = materialize(long, "contributions")
    influential = [r["feature"] for r in explain.top_features(long, 2).collect()]
    curve = metrics.cost_curve(scored, y=y)
    both = metrics.calibration_bins(scored, y=y).withColumn("model", F.lit("fitted")).unionByName(
        metrics.calibration_bins(smooth, y=y).withColumn("model", F.lit("calibrated"))
    )
    found = {
        "learning_curve": learning_curve(outcome.train, outcome.plan, spec.key, folds, sizes),
        "roc_points": metrics.roc_points(scored, y),
        "pr_points": metrics.pr_points(scored, y),
        "calibration": both,
        "confusion": metrics.confusion(scored, outcome.threshold, y),
        "threshold_cost": metrics.marked_cost_curve(curve, outcome.threshold),
        "beeswarm": explain.beeswarm_rows(long),
        "importance": explain.global_importance(long),
        "dependence": explain.dependence_rows(long, spec.key, influential[0], influential[-1]),
        "error_summary": errors.error_summary(classified),
        "error_histogram": errors.error_histogram(classified),
        "segment_errors": errors.segment_errors(classified, segments),
    }
    if outcome.trials is not None:
        names = sorted(outcome.trials.first()["params"])
        wide = outcome.trials.select("number", "value", *[F.col("params")[n].alias(n) for n in names])
        found["tuning_history"] = tuning.running_best(outcome.trials)
        found["param_effect"] = tuning.param_effect(wide, names)
    if outcome.curve is not None:
        found["selection_curve"] = marked_curve(outcome.curve, folds)
    return found


def write_figure_tables(found: Mapping[str, DataFrame], folder: str) -> list[str]:
    for name, table in found.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in found]


class UnknownStageError(ValueError):
    def __init__(self, name: str) -> None:
        super().__init__(f"no stage is named {name!r}; there are {', '.join(STAGES)}")


@dataclass(frozen=True)
class Workspace:
    """Where the stages read and write."""

    raw: str
    folder: str

    @property
    def processed(self) -> str:
        return f"{self.folder}/processed.parquet"

    @property
    def preprocessed(self) -> str:
        return f"{self.folder}/preprocessed.parquet"

    @property
    def log(self) -> str:
        return f"{self.folder}/dataset_log"

    @property
    def index(self) -> str:
        return f"{self.folder}/runs"

    @property
    def model(self) -> str:
        return f"{self.folder}/model"


def run_stages(
    spark: SparkSession,
    place: Workspace,
    stage: str | None = None,
    name: str = DEFAULT_MODEL,
    options: TrainingOptions | None = None,
) -> dict[str, DataFrame]:
    """One stage, or all of them in order; the result of each as a frame."""
    if stage is not None and stage not in STAGES:
        raise UnknownStageError(stage)
    done: dict[str, DataFrame] = {}
    for step in STAGES if stage is None else (stage,):
        if step == "prepare":
            done[step] = catalog.prepare(spark, place.raw, place.processed, place.log)
        elif step == "preprocess":
            frame = tables.training_input(
                spark, APPLICANTS, processed=place.processed, raw=place.raw
            )
            done[step] = catalog.preprocess(frame, place.preprocessed, place.log)
        elif step == "train":
            done[step] = train_stage(spark, place, name, options)
        else:
            done[step] = evaluate_stage(spark, place)
    return done


def train_stage(
    spark: SparkSession, place: Workspace, name: str, options: TrainingOptions | None
) -> DataFrame:
    """Train, save the model and its measures, and add the run to the index."""
    options = options or TrainingOptions()
    frame = tables.training_input(spark, APPLICANTS, processed=place.processed, raw=place.raw)
    outcome = run_training(frame, name, options)
    described = runs.manifest(
        name,
        outcome.plan.params or {},
        outcome.features,
        outcome.threshold,
        asdict(options),
        asdict(KNOBS),
        table_fingerprint(frame).first()["sha256"],
    )
    runs.save_model(outcome.model, place.model)
    runs.save_model(outcome.model, f"{place.folder}/models/{described['run_id']}")
    measured = metrics_row(spark, outcome.metrics)
    runs.save_metrics(measured, f"{place.folder}/metrics")
    runs.record_run(spark, described, outcome.metrics, place.index)
    return measured


def evaluate_stage(spark: SparkSession, place: Workspace, threshold: float | None = None) -> DataFrame:
    """The saved model on the holdout, which is derived again from the same keys and seed.

    Without a threshold the one chosen by the current run is used.
    """
    frame = tables.training_input(spark, APPLICANTS, processed=place.processed, raw=place.raw)
    _, holdout = split_holdout(engineer(frame), ENGINEERED)
    if threshold is None:
        index = runs.run_index(spark.read.parquet(place.index))
        threshold = index.where("is_current").first()["threshold"]
    scored = score_rows(runs.load_model(place.model), holdout)
    return metrics.score_report(scored, threshold, ENGINEERED.target)


def score_file(
    spark: SparkSession, model: PipelineModel, path: str, output: str, threshold: float
) -> DataFrame:
    """Score a file of new applicants and write the decisions as CSV."""
    frame = engineer(tables.scoring_input(spark, path, APPLICANTS))
    scored = predict(model, frame, threshold)
    tables.write_csv(scored, output)
    return scored


def explain_file(
    spark: SparkSession,
    model: PipelineModel,
    path: str,
    output: str,
    threshold: float,
    limit: int | None = None,
) -> DataFrame:
    """Decisions with reasons for a file of new applicants, written as CSV."""
    frame = engineer(tables.scoring_input(spark, path, APPLICANTS))
    if limit is not None:
        frame = tables.first_rows(frame, APPLICANTS.key, limit)
    reasons = explain_decisions(model, frame, APPLICANTS.key, threshold)
    tables.write_csv(reasons, output)
    return reasons
