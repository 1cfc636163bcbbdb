"""Cross-validated scores: everything learned is learned again inside each fold.

The frame given to these functions has a ``fold`` column and should be a stored table
(``materialize``), because every fit reads it again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators.batched_logistic import Fit, FittedBatch, fit_batch
from adjudica.operators.fold_networks import train_networks
from adjudica.operators.classifiers import DEFAULT_MODEL, MODELS, fit_model, score_rows
from adjudica.operators.metrics import ranking_metrics
from adjudica.operators.splits import draw
from adjudica.session import materialize
from adjudica.spec import KNOBS

PARALLEL_FITS = 4
#: Rows up to which the members of a calibrated model, and fits with an embedding, are pipelines of their own.
APART_ROWS = 200_000


def in_parallel(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """Run a few independent fits at once; each is a series of Spark jobs."""
    if len(items) < 2:
        return [work(item) for item in items]
    with ThreadPool(min(PARALLEL_FITS, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


@dataclass(frozen=True)
class ModelPlan:
    """What to fit: columns, classifier and parameters."""

    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    name: str = DEFAULT_MODEL
    params: Mapping[str, float] | None = None
    bottleneck: int | None = None
    network_steps: int = KNOBS.network_steps

    def fit(self, train: DataFrame) -> PipelineModel:
        return fit_model(
            train,
            self.target,
            self.numeric,
            self.categorical,
            self.name,
            self.params,
            self.bottleneck,
            self.network_steps,
        )


def fold_models(frame: DataFrame, plan: ModelPlan, folds: int) -> list[PipelineModel]:
    """One model per fold, fitted on the other folds."""
    return in_parallel(
        frame.sparkSession, lambda k: plan.fit(frame.where(F.col("fold") != k)), range(folds)
    )


def in_one_batch(plan: ModelPlan) -> bool:
    """Whether the plan's fits can be part of one batch of logistic regressions."""
    return plan.name == "logistic_regression" and not plan.bottleneck and set(plan.params or {}) <= {"C"}


def fold_fits(plan: ModelPlan, folds: int) -> list[Fit]:
    """The plan's fit on the other folds, for each fold; a fold is a cell."""
    strength = float((plan.params or {}).get("C", 1.0))
    cells = range(folds)
    return [
        Fit(tuple(plan.numeric), tuple(plan.categorical), frozenset(cells) - {k}, strength) for k in cells
    ]


def batch_out_of_fold(
    frame: DataFrame, plans: Sequence[ModelPlan], folds: int = KNOBS.folds, keep: Sequence[str] = ()
) -> DataFrame:
    """``out_of_fold`` of many plans, all fitted together: kept columns, plan (its place), fold, y and p."""
    target = plans[0].target
    batch, asked = _fold_batch(frame, plans, folds)
    scored = batch.score(frame, asked, keep, "plan int, fold int")
    return scored.withColumn("y", F.col("y").cast(frame.schema[target].dataType))


def _fold_batch(frame: DataFrame, plans: Sequence[ModelPlan], folds: int) -> tuple[FittedBatch, list]:
    """All plans fitted in every fold, and what to score: each fold by the fits that did not see it."""
    fits = [f for plan in plans for f in fold_fits(plan, folds)]
    batch = fit_batch(frame, plans[0].target, "fold", fits)
    asked = [
        (i * folds + k, frozenset([k]), (i, k)) for i in range(len(plans)) for k in range(folds)
    ]
    return batch, asked


def out_of_fold(
    frame: DataFrame, plan: ModelPlan, folds: int = KNOBS.folds, keep: Sequence[str] = ()
) -> DataFrame:
    """Every row scored by the model that did not see it: kept columns, fold, y and p."""
    if in_one_batch(plan):
        return batch_out_of_fold(frame, [plan], folds, keep).drop("plan")
    models = fold_models(frame, plan, folds)
    parts = [
        score_rows(m, frame.where(F.col("fold") == k)).select(
            *keep, "fold", F.col(plan.target).alias("y"), "p"
        )
        for k, m in enumerate(models)
    ]
    return reduce(DataFrame.unionByName, parts)


def _coded_out_of_fold(frame: DataFrame, plan: ModelPlan, folds: int) -> DataFrame:
    """``out_of_fold`` of a regression with an embedding, networks and regressions of all folds together: fold, y and p."""
    known = frame.where(F.col(plan.target).isNotNull() & F.col("fold").isin(*range(folds)))
    known = known.select(plan.target, "fold", *plan.numeric, *plan.categorical)
    plain = fold_fits(plan, folds)
    networks = train_networks(
        known, "fold", plan.numeric, [f.cells for f in plain], plan.bottleneck, steps=plan.network_steps
    )
    coded = materialize(networks.embed(known), "embedded")
    fits = [
        replace(f, numeric=(*f.numeric, *networks.names(k)), plain=frozenset(networks.names(k)))
        for k, f in enumerate(plain)
    ]
    batch = fit_batch(coded, plan.target, "fold", fits)
    return batch.score(coded, [(k, frozenset([k]), (k,)) for k in range(folds)], labels="fold int")


def fold_scores(frame: DataFrame, plan: ModelPlan, folds: int = KNOBS.folds) -> DataFrame:
    """Average precision and ROC AUC of each fold."""
    if in_one_batch(replace(plan, bottleneck=None)) and plan.bottleneck and plan.numeric and frame.count() > APART_ROWS:
        return ranking_metrics(_coded_out_of_fold(frame, plan, folds), keys=["fold"])
    return ranking_metrics(out_of_fold(frame, plan, folds), keys=["fold"])


def _summary(values: list[float]) -> dict:
    mean = sum(values) / len(values)
    deviation = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    return {"mean": mean, "std": deviation, "folds": values}


def cross_validate(frame: DataFrame, plan: ModelPlan, folds: int = KNOBS.folds) -> dict:
    """Mean and population deviation of the average precision over the folds, and the folds."""
    return cross_validate_all(frame, [plan], folds)[0]


def cross_validate_all(frame: DataFrame, plans: Sequence[ModelPlan], folds: int = KNOBS.folds) -> list[dict]:
    """``cross_validate`` of each plan; logistic regressions are fitted and scored together."""
    together = [i for i, plan in enumerate(plans) if in_one_batch(plan)]
    found: dict[int, dict] = {}
    if together:
        batch, asked = _fold_batch(frame, [plans[i] for i in together], folds)
        ranked = batch.ranked(frame, asked, "plan int, fold int")
        rows = ranked.select("plan", "fold", "average_precision").collect()
        for place, i in enumerate(together):
            found[i] = _summary([value for of, _, value in sorted(rows) if of == place])
    for i, plan in enumerate(plans):
        if i not in found:
            rows = fold_scores(frame, plan, folds).select("fold", "average_precision").collect()
            found[i] = _summary([value for _, value in sorted(rows)])
    return [found[i] for i in range(len(plans))]


def compare_models(
    frame: DataFrame,
    plan: ModelPlan,
    folds: int = KNOBS.folds,
    names: Sequence[str] = tuple(MODELS),
    params: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Cross-validated score of each registered classifier, best first."""
    plans = [
        ModelPlan(plan.target, plan.numeric, plan.categorical, name, (params or {}).get(name)) for name in names
    ]
    found = cross_validate_all(frame, plans, folds)
    rows = [(name, each["mean"], each["std"]) for name, each in zip(names, found)]
    table = frame.sparkSession.createDataFrame(rows, "model string, mean double, std double")
    return table.orderBy(F.desc("mean"))


def _with_score(model: PipelineModel | Column, frame: DataFrame, p: str) -> DataFrame:
    return frame.withColumn(p, model) if isinstance(model, Column) else score_rows(model, frame, p)


@dataclass(frozen=True)
class CalibratedModel:
    """Fold models, each with an isotonic correction learned on the fold it did not see.

    A fold model is a pipeline, or the expression of a regression that was fitted with the others.
    """

    members: tuple[tuple[PipelineModel | Column, object], ...]

    def score(self, frame: DataFrame, p: str = "p") -> DataFrame:
        """The mean of the members' corrected probabilities."""
        table = frame
        for i, (model, correction) in enumerate(self.members):
            corrected = correction.setPredictionCol(f"_c{i}").setFeaturesCol(f"_p{i}")
            table = corrected.transform(_with_score(model, table, f"_p{i}"))
        total = reduce(lambda a, b: a + b, [F.col(f"_c{i}") for i in range(len(self.members))])
        return table.select(*frame.columns, (total / len(self.members)).alias(p))


def calibrate(frame: DataFrame, plan: ModelPlan, folds: int = KNOBS.folds) -> CalibratedModel:
    """One member per fold; the regressions of a large table are fitted in one batch."""
    spark, y = frame.sparkSession, F.col(plan.target).cast("double")
    if in_one_batch(plan) and frame.count() > APART_ROWS:
        batch = fit_batch(frame, plan.target, "fold", fold_fits(plan, folds))
        models = [batch.column(k) for k in range(folds)]
        own = reduce(lambda c, k: c.when(F.col("fold") == k, models[k]), range(folds), F)
        known = frame.where(F.col(plan.target).isNotNull() & F.col("fold").isin(*range(folds)))
        scored = known.select("fold", own.alias("p"), y.alias("y"))
        points = materialize(_points(scored, "fold"), "points")
        parts = [points.where(F.col("fold") == k) for k in range(folds)]
        return CalibratedModel(tuple(zip(models, in_parallel(spark, _correction, parts))))

    def member(k: int):
        model = plan.fit(frame.where(F.col("fold") != k))
        scored = score_rows(model, frame.where(F.col("fold") == k)).withColumn("y", y)
        return model, _correction(_points(scored))

    return CalibratedModel(tuple(in_parallel(spark, member, range(folds))))


def _points(scored: DataFrame, *keys: str) -> DataFrame:
    """Equal scores as one weighted point; isotonic regression treats them the same."""
    return scored.groupBy(*keys, "p").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))


def _correction(points: DataFrame):
    return IsotonicRegression(featuresCol="p", labelCol="y", weightCol="n").fit(points)


def learning_curve(
    frame: DataFrame,
    plan: ModelPlan,
    key: str,
    folds: int = KNOBS.folds,
    sizes: int = 8,
    seed: int = KNOBS.seed,
) -> DataFrame:
    """Training and validation score at growing shares (10 % … 100 %) of the training folds.

    The shares are nested: a row enters at a share fixed by its key.
    """
    shares = [0.1 + 0.9 * i / (sizes - 1) for i in range(sizes)] if sizes > 1 else [1.0]
    # A row of step t is in the shares number t, t + 1, …; a cell is a fold and a step.
    u = draw(key, seed, "learning")
    step = sum((u >= share).cast("int") for share in shares[:-1]) if sizes > 1 else F.lit(0)
    celled = frame.withColumn("_cell", F.col("fold") * sizes + step)
    trained = {
        (i, k): frozenset(f * sizes + t for f in range(folds) if f != k for t in range(i + 1))
        for i in range(sizes)
        for k in range(folds)
    }
    held = {k: frozenset(k * sizes + t for t in range(sizes)) for k in range(folds)}
    labels = "i int, k int, set string"
    asked = [
        (n, cells, (i, k, name))
        for n, (i, k) in enumerate(trained)
        for name, cells in (("train", trained[i, k]), ("validation", held[k]))
    ]
    if in_one_batch(plan):
        strength = float((plan.params or {}).get("C", 1.0))
        fits = [Fit(tuple(plan.numeric), tuple(plan.categorical), c, strength) for c in trained.values()]
        found = fit_batch(celled, plan.target, "_cell", fits).ranked(celled, asked, labels)
    else:
        scored = _scored_apart(celled, plan, asked, list(trained.values()))
        counts = scored.groupBy("i", "k", "set").agg(F.count(F.lit(1)).alias("rows"))
        found = ranking_metrics(scored, keys=["i", "k", "set"]).join(F.broadcast(counts), ["i", "k", "set"])
    summary = found.groupBy("i", "set").agg(
        F.avg("rows").alias("rows"),
        F.avg("average_precision").alias("mean"),
        F.stddev_pop("average_precision").alias("std"),
    )
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("i") + 1)
    return summary.select(share.alias("share"), "set", "rows", "mean", "std")


def _scored_apart(frame: DataFrame, plan: ModelPlan, asked, cells: list) -> DataFrame:
    """The rows of ``asked`` scored by one pipeline per training subset, stored because each is costly."""
    models = in_parallel(
        frame.sparkSession, lambda c: plan.fit(frame.where(F.col("_cell").isin(*c))), cells
    )
    parts = [
        score_rows(models[n], frame.where(F.col("_cell").isin(*scored))).select(
            F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(name).alias("set"), F.col(plan.target).cast("double").alias("y"), "p"
        )
        for n, scored, (i, k, name) in asked
    ]
    return materialize(reduce(DataFrame.unionByName, parts), "learning")


def embedding_verdict(frame: DataFrame, plan: ModelPlan, folds: int = KNOBS.folds) -> DataFrame:
    """Cross-validated score with and without the embedding; a gain within one standard error loses."""
    width = plan.bottleneck or KNOBS.bottleneck
    plain = ModelPlan(plan.target, plan.numeric, plan.categorical, plan.name, plan.params)
    coded = ModelPlan(plan.target, plan.numeric, plan.categorical, plan.name, plan.params, width, plan.network_steps)
    without, with_it = cross_validate_all(frame, [plain, coded], folds)
    gain = with_it["mean"] - without["mean"]
    keep = gain > without["std"] / folds**0.5
    # The wording of the verdict.
    rows = [
        ("engineered only", without["mean"], without["std"], 0.0, "baseline"),
        (
            f"engineered + autoencoder({width})",
            with_it["mean"],
            with_it["std"],
            gain,
            "keep" if keep else "drop (no real gain)",
        ),
    ]
    return frame.sparkSession.createDataFrame(
        rows, "features string, cv_pr_auc double, std double, difference double, verdict string"
    )
