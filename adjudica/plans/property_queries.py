"""Properties that results of fitted models must have, as small tables that SQL can state.

A fitted model has no SQL twin, but what it promises has: every row is scored once and by a model that
did not see it, contributions add up to the score, a loaded model equals the saved one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.operators import (
    components,
    detectors,
    fairness,
    outliers,
    rankings,
    splits,
    tree_contributions,
    tuning,
    validation,
)
from adjudica.operators.batched_logistic import fit_batch
from adjudica.operators.classifiers import predict, score_rows
from adjudica.plans import training
from adjudica.plans.decision_queries import classified
from adjudica.plans.model_queries import LINEAR, folded
from adjudica.plans.registry import query, steps
from adjudica.plans.table_queries import TARGET, draw_sql
from adjudica.session import materialize, new_path
from adjudica.sources import fingerprints, fixtures, runs, tables
from adjudica.spec import APPLICANTS, ENGINEERED, KNOBS
from adjudica.streaming import scoring

FOLD_SQL = f"CAST(floor({draw_sql('fold')} * 5) AS INTEGER)"


def holds(*conditions: Column) -> Column:
    """Whether all conditions hold in every row."""
    return F.coalesce(F.bool_and(reduce(lambda a, b: a & b, conditions)), F.lit(True)).alias("holds")


# Rows are scored once, in their own fold, with probabilities.
@query(
    "oof_properties",
    steps("applicants")
    + f"""SELECT fold, count(*) AS n_rows, count(DISTINCT applicant_id) AS n_keys, CAST(sum(LoanApproved) AS BIGINT) AS ones, true AS holds
FROM (SELECT *, {FOLD_SQL} AS fold FROM applicants) f GROUP BY fold""",
)
def oof_properties(spark, folder):
    scored = validation.out_of_fold(folded(spark, folder), LINEAR, keep=["applicant_id"])
    return scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("applicant_id").alias("n_keys"),
        F.sum("y").cast("long").alias("ones"), holds(F.col("p").between(0, 1)),
    )


@query(
    "logistic_optimum",
    "SELECT CAST(k AS INTEGER) AS fit, true AS holds FROM range(0, 25) t(k)",
)
def logistic_optimum(spark, folder):
    """Five penalties in five folds: the gradient of every fit vanishes, in at most 15 scans for all."""
    plans = [
        validation.ModelPlan(TARGET, LINEAR.numeric, LINEAR.categorical, LINEAR.name, {"C": 10.0**power})
        for power in range(-3, 2)
    ]
    fits = [f for plan in plans for f in validation.fold_fits(plan, KNOBS.folds)]
    batch = fit_batch(folded(spark, folder), TARGET, "fold", fits)
    rows = [(k, bool(size < 1e-6 and batch.scans <= 15)) for k, size in enumerate(batch.gradients)]
    return spark.createDataFrame(rows, "fit int, holds boolean")


@query(
    "tuned_properties",
    f"SELECT CAST(k AS INTEGER) AS number, true AS holds FROM range(0, {KNOBS.trials}) t(k)",
)
def tuned_properties(spark, folder):
    """Every trial ends with a score, its parameter is in the space, and the best so far never falls."""
    trials = materialize(tuning.running_best(tuning.tune(folded(spark, folder), LINEAR)), "trials")
    strength = F.col("params")["C"]
    fine = (F.col("state") == "complete") & F.col("value").between(0, 1) & strength.between(1e-3, 1e2)
    return trials.select("number", (fine & (F.col("best_value") >= F.col("value"))).alias("holds"))


@query(
    "selection_curve_properties",
    "SELECT CAST(k AS INTEGER) AS k, true AS holds FROM range(1, " + str(len(ENGINEERED.candidates) + 1) + ") t(k)",
)
def selection_curve_properties(spark, folder):
    """A point per feature count, each with the feature in its place; the last equals the whole model's score."""
    frame, order = folded(spark, folder), ENGINEERED.candidates
    curve = rankings.selection_curve(frame, ENGINEERED, order, "logistic_regression")
    numeric, categorical = ENGINEERED.split_types(order)
    plan = validation.ModelPlan(TARGET, tuple(numeric), tuple(categorical), "logistic_regression")
    whole = validation.cross_validate(frame, plan)
    added = F.element_at(F.array(*[F.lit(c) for c in order]), F.col("k"))
    last = (F.col("k") < len(order)) | (F.abs(F.col("mean") - whole["mean"]) < 1e-4)
    return curve.select("k", ((F.col("added") == added) & F.col("mean").between(0, 1) & (F.col("std") >= 0) & last).alias("holds"))


@query(
    "learning_curve_properties",
    steps("applicants")
    + f"""SELECT i, name AS "set", CAST(sum(CASE WHEN name = 'validation' THEN 1 ELSE 4 END * (name = 'validation' OR u < 0.1 + 0.9 * i / 7)::INTEGER) AS BIGINT) AS rows_of_folds
FROM (SELECT {draw_sql('learning')} AS u FROM applicants) a, range(0, 8) t(i), (VALUES ('train'), ('validation')) s(name) GROUP BY i, name""",
)
def learning_curve_properties(spark, folder):
    """Rows of all folds: each row is validated once at each size and, once in its share, trained on four times."""
    curve = validation.learning_curve(folded(spark, folder), LINEAR, "applicant_id")
    i = F.round((F.col("share") - 0.1) / 0.9 * 7).cast("long")
    return curve.select(i.alias("i"), "set", F.round(F.col("rows") * 5).cast("long").alias("rows_of_folds"))


_all_hold = steps("applicants") + "SELECT count(*) AS n_rows, true AS holds FROM applicants"


@query("shap_additivity", _all_hold)
def shap_additivity(spark, folder):
    """Base and contributions of each row add up to the boosted model's margin."""
    frame = materialize(fixtures.engineered(spark, folder))
    numeric, categorical = ENGINEERED.split_types(ENGINEERED.candidates)
    model = validation.ModelPlan(TARGET, tuple(numeric), tuple(categorical), "sampled_boosting", {"maxIter": 20}).fit(frame)
    long, base = tree_contributions.explain_model(model, frame, "applicant_id")
    sums = long.groupBy("applicant_id").agg(F.sum("contribution").alias("s"))
    raw = model.transform(frame).select("applicant_id", vector_to_array("rawPrediction")[1].alias("r"))
    gap = F.abs(F.col("s") + base - F.col("r"))
    return sums.join(raw, "applicant_id").agg(F.count(F.lit(1)).alias("n_rows"), holds(gap < 1e-9))


@query("reload_properties", _all_hold)
def reload_properties(spark, folder):
    """A saved and loaded model scores every row as before, and its decisions follow the threshold."""
    frame = materialize(fixtures.engineered(spark, folder))
    model, path = LINEAR.fit(frame), new_path(spark, "model")
    runs.save_model(model, path)
    both = predict(runs.load_model(path), score_rows(model, frame, "before"))
    p, decision = F.col("ApprovalProbability"), F.col("LoanApprovedPrediction")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), holds(p == F.col("before"), decision == (p >= KNOBS.threshold).cast("long")))


@query("stream_properties", _all_hold)
def stream_properties(spark, folder):
    """A stream of the applicants gets the scores of the batch."""
    base = new_path(spark, "stream")
    tables.project_features(fixtures.repaired(spark, folder), APPLICANTS).write.parquet(f"{base}/in")
    frame = materialize(fixtures.engineered(spark, folder))
    model = LINEAR.fit(frame)
    scored = scoring.score_stream(scoring.read_stream(spark, f"{base}/in"), model)
    scoring.write_scores(scored, f"{base}/out", f"{base}/state").awaitTermination()
    done = spark.read.parquet(f"{base}/out").select("applicant_id", "ApprovalProbability")
    both = done.join(score_rows(model, frame, "batch").select("applicant_id", "batch"), "applicant_id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), holds(F.abs(F.col("ApprovalProbability") - F.col("batch")) < 1e-12))


# The five lenses: one stored table of flags, read by all its reports.
@query(
    "lens_summary",
    steps("repaired")
    + """SELECT method, CASE WHEN method = 'impossible' THEN (SELECT count(*) FILTER (coalesce(Income < 0, false) OR coalesce(LoanAmount < 0, false)) FROM repaired) END AS rule_flagged,
       true AS holds FROM (VALUES ('impossible'), ('iqr'), ('zscore'), ('isolation_forest'), ('one_class_svm')) m(method)""",
)
def lens_summary(spark, folder):
    """All five lenses side by side; a detector flags its share of the rows, one row more or less per tie."""
    frame = materialize(fixtures.repaired(spark, folder))
    flags = materialize(detectors.all_flags(frame, APPLICANTS), "lenses")
    summary = outliers.flag_summary(flags, detectors.LENSES, TARGET)
    detector = F.col("method").isin(*detectors.DETECTORS)
    share = F.col("share_pct").between(0, 100) & (~detector | (F.abs(F.col("share_pct") - 100 * KNOBS.contamination) < 0.1))
    return summary.select("method", F.when(F.col("method") == "impossible", F.col("flagged")).alias("rule_flagged"), share.alias("holds"))


@query(
    "lens_overlap",
    """WITH m AS (SELECT * FROM (VALUES ('impossible'), ('iqr'), ('zscore'), ('isolation_forest'), ('one_class_svm')) v(method))
SELECT a.method AS "left", b.method AS "right", CASE WHEN a.method = b.method THEN 1.0::DOUBLE END AS own, true AS holds FROM m a, m b""",
)
def lens_overlap(spark, folder):
    """The overlaps of all lenses: one with itself, symmetric, never above one."""
    frame = materialize(fixtures.repaired(spark, folder))
    flags = materialize(detectors.all_flags(frame, APPLICANTS), "lenses")
    found = materialize(outliers.flag_jaccard(flags, detectors.LENSES), "overlaps")
    turned = found.select(F.col("left").alias("right"), F.col("right").alias("left"), F.col("jaccard").alias("other"))
    fine = F.col("jaccard").between(0, 1) & (F.col("jaccard") == F.col("other"))
    own = F.when(F.col("left") == F.col("right"), F.col("jaccard"))
    return found.join(turned, ["left", "right"]).select("left", "right", own.alias("own"), fine.alias("holds"))


@query("pca_properties", f"SELECT CAST(k AS INTEGER) AS component, true AS holds FROM range(1, {len(APPLICANTS.numeric) + 1}) t(k)")
def pca_properties(spark, folder):
    """Shares fall and their running sums end at one."""
    found = materialize(components.pca_scree(fixtures.repaired(spark, folder), APPLICANTS.numeric), "scree")
    after = found.select((F.col("component") - 1).alias("component"), F.col("share").alias("next"))
    last = F.abs(F.col("cumulative") - 1) < 1e-9
    fine = F.coalesce(F.col("next") <= F.col("share"), last)
    return found.join(after, "component", "left").select("component", fine.alias("holds"))


@query(
    "impact_interval_properties",
    steps("classified")
    + """SELECT round(min(r) / max(r), 6) AS impact_ratio, true AS holds
FROM (SELECT avg(predicted) AS r FROM classified WHERE City IS NOT NULL GROUP BY City) t""",
)
def impact_interval_properties(spark, folder):
    """The bounds lie around the ratio of the whole table."""
    found = fairness.impact_interval(classified(spark, folder), "City")
    low, high, point = (F.col(c) for c in ("lower_95", "upper_95", "impact_ratio"))
    return found.select(F.round(point, 6).alias("impact_ratio"), ((low <= high) & point.between(low - 0.05, high + 0.05)).alias("holds"))


@query("fingerprint_properties", "SELECT true AS same_in_any_order, true AS other_with_a_repeat")
def fingerprint_properties(spark, folder):
    """The order of rows does not matter, a repeated row does."""
    frame = fixtures.repaired(spark, folder)
    first = frame.orderBy("applicant_id").limit(1)
    a, b, c = (fingerprints.table_fingerprint(f).select("sha256") for f in (frame, frame.repartition(7, "City"), frame.union(first)))
    row = a.select(F.col("sha256").alias("a")).crossJoin(b.select(F.col("sha256").alias("b"))).crossJoin(c.select(F.col("sha256").alias("c")))  # one row each
    return row.select((F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("other_with_a_repeat"))


# Whole runs that had no query.


@query("embedding_verdict")
def embedding_verdict(spark, folder):
    """The whole comparison with and without the embedding; its rule is tested on a small table."""
    numeric, categorical = ENGINEERED.split_types(ENGINEERED.candidates)
    plan = validation.ModelPlan(TARGET, tuple(numeric), tuple(categorical), "logistic_regression")
    return validation.embedding_verdict(folded(spark, folder), plan)


@query(
    "saved_evaluation",
    steps("engineered")
    + f"""SELECT count(*) AS holdout_rows, CAST(sum(LoanApproved) AS BIGINT) AS ones FROM engineered WHERE {draw_sql('holdout')} < 0.2""",
)
def saved_evaluation(spark, folder):
    """Prepare, preprocess and train from a raw file, then the saved model on the holdout derived again."""
    base = new_path(spark, "stages")
    tables.write_csv(fixtures.applicants(spark, folder), f"{base}/raw.csv")
    done = training.run_stages(spark, training.Workspace(f"{base}/raw.csv", base), name="logistic_regression")
    cells = [F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")]
    report = done["evaluate"]
    return report.select(sum(cells[1:], cells[0]).alias("holdout_rows"), (cells[2] + cells[3]).alias("ones"))
