"""Random search over a classifier's declared space, and reports over its trials."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.attach import attach, long_form
from adjudica.functions.ordering import quantile_row
from adjudica.operators.classifiers import get_model
from adjudica.operators.profile import band_index
from adjudica.operators.validation import ModelPlan, cross_validate_all
from adjudica.spec import KNOBS


def draw_params(name: str, trials: int, seed: int = KNOBS.seed) -> list[dict]:
    """Seeded parameter sets from the model's search space."""
    space = get_model(name).space
    source = random.Random(seed)
    return [{p: r.draw(source) for p, r in space.items()} for _ in range(trials)]


def tune(
    frame: DataFrame,
    plan: ModelPlan,
    trials: int = KNOBS.trials,
    folds: int = KNOBS.folds,
    seed: int = KNOBS.seed,
    fixed: dict | None = None,
) -> DataFrame:
    """One row per trial: number, cross-validated score, parameters, state.

    ``fixed`` overrides drawn parameters. The holdout is never read here.
    """
    tried = [{**drawn, **(fixed or {})} for drawn in draw_params(plan.name, trials, seed)]
    plans = [ModelPlan(plan.target, plan.numeric, plan.categorical, plan.name, params) for params in tried]
    scores = cross_validate_all(frame, plans, folds)
    rows = [
        (i, score["mean"], {p: float(v) for p, v in params.items()}, "complete")
        for i, (params, score) in enumerate(zip(tried, scores))
    ]
    return frame.sparkSession.createDataFrame(
        rows, "number int, value double, params map<string,double>, state string"
    )


def best_params(trials: DataFrame, name: str) -> dict:
    """Parameters of the best trial, whole numbers restored."""
    space = get_model(name).space
    row = trials.where("value is not null").orderBy(F.desc("value"), "number").first()
    return {
        p: int(v) if p in space and space[p].kind == "int" else v for p, v in row["params"].items()
    }


def running_best(trials: DataFrame) -> DataFrame:
    """Trials in order with the best value so far; there are as many rows as trials."""
    w = Window.partitionBy(F.lit(0)).orderBy("number").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return trials.where("value is not null").withColumn("best_value", F.max("value").over(w))


def param_effect(trials: DataFrame, params: Sequence[str], value: str = "value") -> DataFrame:
    """Share of the score's variation that lies between quartile bands of each parameter."""
    known = trials.where(F.col(value).isNotNull())
    cuts = quantile_row(known, params, [0.0, 0.25, 0.5, 0.75, 1.0])
    banded = attach(known, cuts, name="_q").select(
        F.col(value).alias("_value"),
        *[band_index(F.col(p).cast("double"), F.array_distinct(f"_q.{p}")).alias(p) for p in params],
    )
    bands = long_form(banded, params, keep=["_value"], feature="param", value="band")
    groups = bands.where("band is not null").groupBy("param", "band").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_value").alias("mean"), F.var_pop("_value").alias("var")
    )
    whole = groups.groupBy("param").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    )
    spread = F.col("n") * F.pow(F.col("mean") - F.col("_g.grand"), 2)
    shares = (
        attach(groups, whole, ["param"], "_g")
        .groupBy("param")
        .agg(F.sum(spread).alias("between"), F.sum(spread + F.col("n") * F.col("var")).alias("all"))
    )
    share = F.coalesce(F.try_divide("between", "all"), F.lit(0.0))
    return shares.select("param", share.alias("effect")).orderBy(F.desc("effect"), "param")
