"""Queries that fit models, draw at random, or keep a record of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.operators import (
    association,
    components,
    detectors,
    explain,
    metrics,
    outliers,
    profile,
    rankings,
    splits,
    tree_contributions,
    tuning,
    validation,
)
from adjudica.operators.classifiers import predict
from adjudica.operators.preprocess import (
    HOT,
    SCALED,
    MedianScaler,
    category_stages,
    preprocessor,
)
from adjudica.plans import training
from adjudica.plans.registry import query, rounded, steps
from adjudica.plans.table_queries import ALL_CATEGORICAL, ALL_NUMERIC, DOCS, TARGET, per_column
from adjudica.session import materialize, new_path
from adjudica.sources import catalog, fingerprints, fixtures, runs, tables
from adjudica.spec import APPLICANTS, ENGINEERED, KNOBS
from adjudica.streaming import scoring

LINEAR = validation.ModelPlan(
    TARGET, tuple(ALL_NUMERIC), tuple(ALL_CATEGORICAL), "logistic_regression"
)
BOOSTED = validation.ModelPlan(
    TARGET, tuple(ALL_NUMERIC), tuple(ALL_CATEGORICAL), "sampled_boosting"
)


def folded(spark, folder, folds: int = KNOBS.folds):
    """The engineered table with folds, stored once because every fit reads it again."""
    frame = fixtures.engineered(spark, folder)
    return materialize(splits.assign_folds(frame, ENGINEERED, folds), "folded")


# Preprocessing that SQL can repeat.


@query(
    "standardized",
    steps("engineered")
    + "SELECT applicant_id, "
    + ", ".join(
        f"round((coalesce({c}, md_{c}) - avg(coalesce({c}, md_{c})) OVER ()) / stddev_pop(coalesce({c}, md_{c})) OVER (), 6) AS {c}__scaled"
        for c in APPLICANTS.numeric
    )
    + " FROM engineered, (SELECT "
    + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS md_{c}" for c in APPLICANTS.numeric
    )
    + " FROM engineered) m",
)
def standardized(spark, folder):
    frame = fixtures.engineered(spark, folder)
    model = MedianScaler(APPLICANTS.numeric).fit(frame)
    scaled = model.transform(frame)
    return rounded(scaled.select("applicant_id", *[c + SCALED for c in APPLICANTS.numeric]))


ONE_HOT = ENGINEERED.categorical


@query(
    "one_hot",
    steps("engineered")
    + per_column(
        ONE_HOT,
        """SELECT applicant_id, '{c}' AS feature, level, CAST(coalesce({c}, 'Missing') = level AS INTEGER) AS hot
FROM engineered, (SELECT DISTINCT coalesce({c}, 'Missing') AS level FROM engineered) l""",
    ),
)
def one_hot(spark, folder):
    """Each encoded slot as a row, so that the twin needs no vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    frame = fixtures.engineered(spark, folder)
    model = Pipeline(stages=category_stages(ONE_HOT)).fit(frame)
    levels = dict(zip(ONE_HOT, model.stages[1].labelsArray))
    slots = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(level).alias("level"),
                F.get(vector_to_array(c + HOT), F.lit(i)).cast("int").alias("hot"),
            )
            for c in ONE_HOT
            for i, level in enumerate(levels[c])
        ]
    )
    return model.transform(frame).select("applicant_id", F.inline(slots))


@query("neighbour_mi")
def neighbour_mi(spark, folder):
    """Its direct definition compares all pairs of rows, so it is tested on a small frame instead."""
    frame = fixtures.repaired(spark, folder)
    return association.neighbour_information(frame, APPLICANTS.numeric, TARGET)


# Outliers of a skewed table, where the rules fire.

_doc_numeric = fixtures.DOCUMENTS.numeric


@query(
    "documents_outlier_summary",
    f"WITH {DOCS}\n"
    + per_column(
        _doc_numeric,
        """SELECT '{c}' AS feature, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) AS iqr_low,
       count(*) FILTER ({c} > q3 + 1.5 * (q3 - q1)) AS iqr_high, count(*) FILTER (abs(({c} - m) / s) > 3) AS z_over_3,
       CAST(0 AS BIGINT) AS impossible_negative
FROM labelled, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
                       avg({c}) AS m, stddev_samp({c}) AS s FROM labelled) f""",
    ),
)
def documents_outlier_summary(spark, folder):
    return profile.outlier_summary(fixtures.labelled_documents(spark, folder), _doc_numeric)


_doc_any = lambda text: " OR ".join(text.replace("{c}", c) for c in _doc_numeric)
DOC_FLAGS = (
    f"""flagged AS (SELECT l.*, false AS impossible,
       {_doc_any('{c} < q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) OR {c} > q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1])')} AS iqr,
       {_doc_any('abs(({c} - m_{c}) / s_{c}) > 3')} AS zscore
FROM labelled l, (SELECT """
    + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q_{c}, avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}"
        for c in _doc_numeric
    )
    + " FROM labelled) s)"
)


@query(
    "documents_consensus",
    f"WITH {DOCS},\n{DOC_FLAGS}\n"
    + """SELECT doc_id, impossible, iqr, zscore, CAST(iqr AS INTEGER) + CAST(zscore AS INTEGER) >= 2 AS consensus FROM flagged""",
)
def documents_consensus(spark, folder):
    frame = fixtures.labelled_documents(spark, folder)
    marked = outliers.consensus(
        outliers.rule_flags(frame, fixtures.DOCUMENTS), outliers.RULES, 2
    )
    return marked.select("doc_id", *outliers.RULES, "consensus")


@query(
    "documents_flag_jaccard",
    f"WITH {DOCS},\n{DOC_FLAGS}\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", round(coalesce(CAST(count(*) FILTER ({a} AND {b}) AS DOUBLE)
       / nullif(count(*) FILTER ({a} OR {b}), 0), 1), 6) AS jaccard FROM flagged"""
        for a in outliers.RULES
        for b in outliers.RULES
    ),
)
def documents_flag_jaccard(spark, folder):
    frame = fixtures.labelled_documents(spark, folder)
    return rounded(
        outliers.flag_jaccard(outliers.rule_flags(frame, fixtures.DOCUMENTS), outliers.RULES)
    )


# Trials whose parameters and scores SQL can compute: one trial per age, from all its applicants.

_trials_sql = """SELECT CAST(Age AS INTEGER) AS number, round(avg(LoanApproved), 6) AS value,
       round(avg(LoanAmount), 4) AS loan, round(avg(YearsExperience), 4) AS experience
FROM repaired GROUP BY Age"""


def age_trials(spark, folder):
    return fixtures.repaired(spark, folder).groupBy(F.col("Age").cast("int").alias("number")).agg(
        F.round(F.avg(TARGET), 6).alias("value"),
        F.round(F.avg("LoanAmount"), 4).alias("loan"),
        F.round(F.avg("YearsExperience"), 4).alias("experience"),
    )


@query(
    "running_best",
    steps("repaired", trials=_trials_sql)
    + """SELECT number, value, loan, experience,
       max(value) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_value FROM trials""",
)
def running_best(spark, folder):
    return tuning.running_best(age_trials(spark, folder))


def _effect_sql(param: str) -> str:
    return f"""SELECT '{param}' AS param, round(coalesce(sum(n * (m - gm) * (m - gm)) / max(sst), 0), 6) AS effect
FROM (SELECT band, count(*) AS n, avg(value) AS m FROM
        (SELECT value, len(list_filter(e[2:len(e) - 1], lambda x: x < {param})) AS band
         FROM trials, (SELECT list_sort(list_distinct(quantile_cont({param}, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM trials) q) b
      GROUP BY band) g, (SELECT avg(value) AS gm, var_pop(value) * count(*) AS sst FROM trials) t"""


@query(
    "param_effect",
    steps("repaired", trials=_trials_sql)
    + _effect_sql("loan")
    + "\nUNION ALL\n"
    + _effect_sql("experience"),
)
def param_effect(spark, folder):
    return rounded(tuning.param_effect(age_trials(spark, folder), ["loan", "experience"]))


# Run and dataset records.


@query(
    "run_index",
    """WITH entries AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, o_orderdate AS created_at, o_orderkey, o_totalprice AS average_precision FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC) AS rn FROM entries),
newest AS (SELECT run_id, max(created_at) AS created_at FROM entries GROUP BY run_id)
SELECT run_id, created_at, run_id = (SELECT run_id FROM newest ORDER BY created_at DESC, run_id DESC LIMIT 1) AS is_current FROM newest""",
)
def run_index(spark, folder):
    """Orders as run entries: a customer is a run recorded once per order."""
    entries = fixtures.load(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("created_at")
    )
    return runs.run_index(entries)


@query(
    "dataset_log",
    steps("applicants", "engineered")
    + """SELECT 'processed' AS stage, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, CAST(0 AS INTEGER) AS n_derived FROM repaired
UNION ALL SELECT 'preprocessed', count(*), CAST(21 AS BIGINT), CAST(10 AS INTEGER) FROM engineered""",
)
def dataset_log(spark, folder):
    """Prepare and preprocess from a raw CSV; the record keeps one row per stage."""
    base = new_path(spark, "prepare")
    tables.write_csv(fixtures.applicants(spark, folder), f"{base}/raw.csv")
    prepared = catalog.prepare(spark, f"{base}/raw.csv", f"{base}/processed.parquet", f"{base}/log")
    catalog.preprocess(prepared, f"{base}/preprocessed.parquet", f"{base}/log")
    latest = catalog.latest_stages(spark, f"{base}/log").where("stage <> 'raw'")
    return latest.select("stage", "n_rows", "n_columns", F.size("derived").alias("n_derived"))


@query("table_fingerprint")
def table_fingerprint(spark, folder):
    return fingerprints.table_fingerprint(fixtures.repaired(spark, folder))


@query("file_fingerprints")
def file_fingerprints(spark, folder):
    found = fingerprints.file_fingerprints(spark, f"{folder}/orders.parquet")
    return found.select("length", "sha256")


# Fitted models.


@query("cv_score")
def cv_score(spark, folder):
    return validation.fold_scores(folded(spark, folder), LINEAR)


@query("oof")
def oof(spark, folder):
    return validation.out_of_fold(folded(spark, folder), LINEAR, keep=["applicant_id"])


@query("model_comparison")
def model_comparison(spark, folder):
    """Every classifier with its defaults: the comparison's cost is the sum of its members'."""
    return validation.compare_models(folded(spark, folder), LINEAR)


@query("calibrated")
def calibrated(spark, folder):
    """Fitted on the training rows and reported on the holdout, which no fold model has seen."""
    marked = materialize(splits.mark_holdout(folded(spark, folder), ENGINEERED), "marked")
    model = validation.calibrate(marked.where("not is_holdout"), LINEAR)
    return metrics.score_report(model.score(marked.where("is_holdout")), y=TARGET)


@query("learning_curve")
def learning_curve(spark, folder):
    return validation.learning_curve(folded(spark, folder), LINEAR, "applicant_id")


@query("tuned")
def tuned(spark, folder):
    trials = tuning.tune(folded(spark, folder), LINEAR)
    return tuning.running_best(trials).select("number", "value", "best_value", "state")


@query("gain_rank")
def gain_rank(spark, folder):
    frame = materialize(fixtures.engineered(spark, folder))
    return rankings.gain_ranking(frame, ENGINEERED, ENGINEERED.candidates)


@query("perm_rank")
def perm_rank(spark, folder):
    frame = materialize(fixtures.engineered(spark, folder))
    return rankings.permutation_ranking(
        frame, ENGINEERED, ENGINEERED.candidates, "logistic_regression"
    )


@query("selection_curve")
def selection_curve(spark, folder):
    frame = folded(spark, folder)
    return rankings.selection_curve(
        frame, ENGINEERED, ENGINEERED.candidates, "logistic_regression"
    )


@query("feature_ranking")
def feature_ranking(spark, folder):
    frame = materialize(fixtures.engineered(spark, folder))
    return rankings.rank_features(
        frame, ENGINEERED, ENGINEERED.candidates, "logistic_regression"
    )


@query("tree_shap")
def tree_shap(spark, folder):
    frame = materialize(fixtures.engineered(spark, folder))
    model = BOOSTED.fit(frame)
    long, _ = tree_contributions.explain_model(model, frame, "applicant_id")
    return long


@query("shap_importance")
def shap_importance(spark, folder):
    frame = materialize(fixtures.engineered(spark, folder))
    model = BOOSTED.fit(frame)
    long, _ = tree_contributions.explain_model(model, frame, "applicant_id")
    return explain.global_importance(long)


@query("model_reasons")
def model_reasons(spark, folder):
    frame = materialize(fixtures.engineered(spark, folder))
    model = BOOSTED.fit(frame)
    return tree_contributions.explain_decisions(model, frame, "applicant_id")


@query("batch_scores")
def batch_scores(spark, folder):
    """Fit, save, load, and score all rows with the loaded model."""
    frame = materialize(fixtures.engineered(spark, folder))
    path = new_path(spark, "model")
    runs.save_model(LINEAR.fit(frame), path)
    scored = predict(runs.load_model(path), frame.drop(TARGET))
    return scored.select("applicant_id", "ApprovalProbability", "LoanApprovedPrediction")


@query("holdout_report")
def holdout_report(spark, folder):
    frame = fixtures.engineered(spark, folder)
    _, report = training.train_simple(frame, ENGINEERED, "logistic_regression")
    return report


@query("iforest")
def iforest(spark, folder):
    encoded = materialize(detectors.encode(fixtures.repaired(spark, folder), APPLICANTS))
    score = detectors.isolation_score(encoded, "applicant_id")
    return encoded.select("applicant_id", score.alias("score"))


@query("ocsvm")
def ocsvm(spark, folder):
    frame = materialize(fixtures.repaired(spark, folder))
    encoded = materialize(detectors.encode(frame, APPLICANTS))
    score = detectors.one_class_score(encoded)
    return encoded.select("applicant_id", score.alias("score"))


@query("clean_train")
def clean_train(spark, folder):
    frame = materialize(fixtures.repaired(spark, folder))
    kept, _ = detectors.clean_training_rows(frame, APPLICANTS)
    return kept


@query("embedding")
def embedding(spark, folder):
    frame = materialize(fixtures.engineered(spark, folder))
    model = preprocessor(APPLICANTS.numeric, [], 3).fit(frame)
    return model.transform(frame).select("applicant_id", *[f"autoencoder_{i}" for i in range(3)])


@query("pca_scree")
def pca_scree(spark, folder):
    return components.pca_scree(fixtures.repaired(spark, folder), APPLICANTS.numeric)


@query("pca_map")
def pca_map(spark, folder):
    frame = materialize(fixtures.repaired(spark, folder))
    return components.pca_map(
        frame, APPLICANTS.numeric, APPLICANTS.categorical, ["applicant_id", TARGET]
    )


@query("training_run")
def training_run(spark, folder):
    frame = fixtures.repaired(spark, folder)
    outcome = training.run_training(frame, "logistic_regression")
    return training.metrics_row(spark, outcome.metrics)


@query("stream_scores")
def stream_scores(spark, folder):
    """A file stream of all applicants scored to the end with a fitted model."""
    base = new_path(spark, "stream")
    rows = fixtures.repaired(spark, folder)
    tables.project_features(rows, APPLICANTS).write.parquet(f"{base}/in")
    model = LINEAR.fit(materialize(fixtures.engineered(spark, folder)))
    scored = scoring.score_stream(scoring.read_stream(spark, f"{base}/in"), model)
    scoring.write_scores(scored, f"{base}/out", f"{base}/state").awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return done.select("applicant_id", "ApprovalProbability", "LoanApprovedPrediction")
