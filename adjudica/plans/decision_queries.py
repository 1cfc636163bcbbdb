"""Queries over scored tables: metrics, thresholds, explanations, errors and fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.functions.attach import stacked
from adjudica.operators import errors, explain, fairness, metrics, selection
from adjudica.plans.registry import query, rounded, steps
from adjudica.plans.table_queries import ALL_CATEGORICAL, ALL_NUMERIC, TARGET, per_column
from adjudica.sources import fixtures


def scored(spark, folder):
    frame = fixtures.scorecard(fixtures.engineered(spark, folder))
    return frame.withColumn("y", F.col(TARGET))


def classified(spark, folder):
    return errors.classify(scored(spark, folder))


STEP_SQL = """SELECT score, o, z, CAST(sum(o) OVER w AS DOUBLE) AS tp, CAST(sum(z) OVER w AS DOUBLE) AS fp,
       CAST(sum(o) OVER () AS DOUBLE) AS ones, CAST(sum(z) OVER () AS DOUBLE) AS zeros
FROM (SELECT p AS score, CAST(sum(y) AS DOUBLE) AS o, CAST(sum(1 - y) AS DOUBLE) AS z FROM scored GROUP BY p) s
WINDOW w AS (ORDER BY score DESC)"""


@query(
    "score_report",
    steps("scored", steps=STEP_SQL)
    + """SELECT r.average_precision AS average_precision, r.roc_auc AS roc_auc, round(brier, 6) AS brier_score,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / n, 6) AS accuracy,
       CAST(0.5 AS DOUBLE) AS threshold, CAST(tn AS BIGINT) AS true_negatives, CAST(fp AS BIGINT) AS false_positives,
       CAST(fn AS BIGINT) AS false_negatives, CAST(tp AS BIGINT) AS true_positives
FROM (SELECT avg((p - y) * (p - y)) AS brier, CAST(count(*) AS DOUBLE) AS n,
             CAST(count(*) FILTER (p >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (p >= 0.5 AND y = 0) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (p < 0.5 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (p < 0.5 AND y = 0) AS DOUBLE) AS tn
      FROM scored) c,
     (SELECT round(sum(o / ones * tp / (tp + fp)), 6) AS average_precision,
             round(sum(z * (tp - o / 2)) / max(ones * zeros), 6) AS roc_auc FROM steps) r""",
)
def score_report(spark, folder):
    return rounded(metrics.score_report(scored(spark, folder)))


@query(
    "roc_points",
    steps("scored", steps=STEP_SQL)
    + "SELECT round(score, 6) AS score, round(fp / zeros, 6) AS false_positive_rate, round(tp / ones, 6) AS true_positive_rate FROM steps",
)
def roc_points(spark, folder):
    return rounded(metrics.roc_points(scored(spark, folder)))


@query(
    "pr_points",
    steps("scored", steps=STEP_SQL)
    + "SELECT round(score, 6) AS score, round(tp / (tp + fp), 6) AS precision, round(tp / ones, 6) AS recall FROM steps",
)
def pr_points(spark, folder):
    return rounded(metrics.pr_points(scored(spark, folder)))


COST_SQL = """SELECT t AS threshold, count(*) FILTER (p >= t AND y = 0) AS false_approvals,
       count(*) FILTER (p < t AND y = 1) AS false_rejections,
       CAST(5 * count(*) FILTER (p >= t AND y = 0) + count(*) FILTER (p < t AND y = 1) AS DOUBLE) AS expected_cost
FROM (SELECT CAST(5 + i AS DOUBLE) / 100 AS t FROM range(91) r(i)) g, scored GROUP BY t"""


@query(
    "cost_curve",
    steps("scored", curve=COST_SQL, best="SELECT min(threshold) AS b FROM curve WHERE expected_cost = (SELECT min(expected_cost) FROM curve)")
    + """SELECT round(threshold, 6) AS threshold, false_approvals, false_rejections, expected_cost,
       abs(threshold - 0.6) < 1e-9 AS is_chosen, threshold = b AS is_optimal, abs(threshold - 0.5) < 1e-9 AS is_default
FROM curve, best""",
)
def cost_curve(spark, folder):
    curve = metrics.cost_curve(scored(spark, folder))
    return rounded(metrics.marked_cost_curve(curve, 0.6))


@query(
    "best_threshold",
    steps("scored", curve=COST_SQL)
    + """SELECT round(min(threshold), 6) AS threshold, min(expected_cost) AS expected_cost FROM curve
WHERE expected_cost = (SELECT min(expected_cost) FROM curve)""",
)
def best_threshold(spark, folder):
    return rounded(metrics.best_threshold(metrics.cost_curve(scored(spark, folder))))


_deciles = ", ".join(repr(i / 10) for i in range(11))


@query(
    "calibration_bins",
    steps(
        "scored",
        edges=f"SELECT list_sort(list_distinct(quantile_cont(p, [{_deciles}]))) AS e FROM scored",
        binned="SELECT p, y, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < p)) AS INTEGER) AS bin FROM scored, edges",
    )
    + "SELECT bin, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate, count(*) AS n FROM binned GROUP BY bin",
)
def calibration_bins(spark, folder):
    return rounded(metrics.calibration_bins(scored(spark, folder)))


@query(
    "confusion",
    steps("scored")
    + """SELECT CAST(a AS INTEGER) AS actual, CAST(b AS INTEGER) AS predicted,
       (SELECT count(*) FROM scored WHERE y = a AND CAST(p >= 0.5 AS INTEGER) = b) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b)""",
)
def confusion(spark, folder):
    return metrics.confusion(scored(spark, folder))


@query(
    "outcomes",
    steps("classified")
    + "SELECT applicant_id, predicted, outcome, is_error, round(confidence_error, 6) AS confidence_error FROM classified",
)
def outcomes(spark, folder):
    return rounded(
        classified(spark, folder).select(
            "applicant_id", "predicted", "outcome", "is_error", "confidence_error"
        )
    )


@query(
    "error_summary",
    steps("classified")
    + """SELECT k AS outcome, (SELECT count(*) FROM classified WHERE outcome = k) AS "count",
       round((SELECT count(*) FROM classified WHERE outcome = k) * 100.0 / (SELECT count(*) FROM classified), 6) AS share_pct,
       round((SELECT avg(p) FROM classified WHERE outcome = k), 6) AS mean_probability
FROM (VALUES ('true_negative'), ('false_positive'), ('false_negative'), ('true_positive')) v(k)""",
)
def error_summary(spark, folder):
    return rounded(errors.error_summary(classified(spark, folder)))


PROFILED = ["Age", "Income", "LoanAmount", "CreditScore", "debt_to_income", "experience_per_age"]


@query(
    "error_profile",
    steps("classified")
    + per_column(
        PROFILED,
        """SELECT '{c}' AS feature, round(avg({c}) FILTER (is_error), 6) AS mean_when_wrong, round(avg({c}) FILTER (NOT is_error), 6) AS mean_when_right,
       round(avg({c}) FILTER (is_error) - avg({c}) FILTER (NOT is_error), 6) AS difference FROM classified""",
    ),
)
def error_profile(spark, folder):
    return rounded(errors.error_profile(classified(spark, folder), [*PROFILED, "Gender"]))


SEGMENTS = ["EmploymentType", "credit_band"]


@query(
    "segment_errors",
    steps("classified")
    + per_column(
        SEGMENTS,
        """SELECT '{c}' AS segment, {c} AS value, count(*) AS applicants, round(avg(CAST(is_error AS INTEGER)), 6) AS error_rate,
       round(avg(CAST(outcome = 'false_positive' AS INTEGER)), 6) AS false_positive_rate,
       round(avg(CAST(outcome = 'false_negative' AS INTEGER)), 6) AS false_negative_rate,
       round((SELECT avg(CAST(is_error AS INTEGER)) FROM classified), 6) AS population_error_rate
FROM classified WHERE {c} IS NOT NULL GROUP BY {c}""",
    ),
)
def segment_errors(spark, folder):
    return rounded(errors.segment_errors(classified(spark, folder), SEGMENTS))


@query(
    "confident_mistakes",
    steps("classified")
    + """SELECT applicant_id, outcome, round(p, 6) AS p, round(confidence_error, 6) AS confidence_error FROM classified
WHERE is_error ORDER BY confidence_error DESC, applicant_id LIMIT 10""",
)
def confident_mistakes(spark, folder):
    rows = errors.confident_mistakes(classified(spark, folder), "applicant_id")
    return rounded(rows.select("applicant_id", "outcome", "p", "confidence_error"))


@query(
    "error_hist",
    steps(
        "classified",
        binned="""SELECT is_error, lo, w, CAST(least(floor((p - lo) / w), 29) AS BIGINT) AS bin FROM classified,
       (SELECT min(p) AS lo, (max(p) - min(p)) / 30 AS w FROM classified) r""",
    )
    + """SELECT is_error, bin, round(lo + w * bin, 6) AS low, count(*) AS n,
       round(CAST(count(*) AS DOUBLE) / (CAST(sum(count(*)) OVER (PARTITION BY is_error) AS DOUBLE) * w), 6) AS density
FROM binned GROUP BY is_error, bin, lo, w""",
)
def error_hist(spark, folder):
    return rounded(errors.error_histogram(classified(spark, folder)))


PROTECTED = ["Gender", "City"]


@query("fairness_audit", steps("audit") + "SELECT * FROM audit")
def fairness_audit(spark, folder):
    return fairness.fairness_audit(classified(spark, folder), PROTECTED)


@query(
    "group_rates",
    steps("audit")
    + """SELECT attribute, "group", selection_rate, round(avg(selection_rate) OVER w, 6) AS mean_selection_rate,
       error_rate, round(avg(error_rate) OVER w, 6) AS mean_error_rate FROM audit WINDOW w AS (PARTITION BY attribute)""",
)
def group_rates(spark, folder):
    return rounded(
        fairness.group_rates(fairness.fairness_audit(classified(spark, folder), PROTECTED))
    )


@query(
    "disparate_impact",
    steps("audit")
    + """SELECT attribute, lo AS lowest_selection_rate, hi AS highest_selection_rate, round(coalesce(lo / nullif(hi, 0), 0), 3) AS impact_ratio,
       coalesce(lo / nullif(hi, 0), 0) >= 0.8 AS passes_four_fifths, round(gap, 3) AS false_negative_gap
FROM (SELECT attribute, min(selection_rate) AS lo, max(selection_rate) AS hi,
             max(false_negative_rate) - min(false_negative_rate) AS gap FROM audit GROUP BY attribute) t""",
)
def disparate_impact(spark, folder):
    audit = fairness.fairness_audit(classified(spark, folder), PROTECTED)
    return fairness.disparate_impact(audit)


@query(
    "impact_ratio",
    steps("classified")
    + """SELECT round(min(r) / max(r), 6) AS impact_ratio, min(r) / max(r) >= 0.8 AS passes_four_fifths
FROM (SELECT avg(predicted) AS r FROM classified WHERE City IS NOT NULL GROUP BY City) t""",
)
def impact_ratio(spark, folder):
    return rounded(fairness.impact_ratio(classified(spark, folder), "City"))


@query("impact_ci")
def impact_ci(spark, folder):
    """The bootstrap draws are random, so only the point estimate has a twin (impact_ratio)."""
    return fairness.impact_interval(classified(spark, folder), "City")


WEIGHTS = {
    "low_credit_score": -0.25,
    "low_income": -0.2,
    "is_unemployed": -0.3,
    "EmploymentType_Self-Employed": 0.05,
}


def contributions(spark, folder):
    frame = fixtures.engineered(spark, folder).withColumn(
        "EmploymentType_Self-Employed", (F.col("EmploymentType") == "Self-Employed").cast("int")
    )
    return explain.linear_contributions(frame, "applicant_id", WEIGHTS)


@query(
    "linear_contributions",
    steps("contributions")
    + "SELECT applicant_id, feature, value, round(contribution, 6) AS contribution FROM contributions",
)
def linear_contributions(spark, folder):
    return rounded(contributions(spark, folder))


@query(
    "global_importance",
    steps("contributions")
    + "SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs_contribution FROM contributions GROUP BY feature",
)
def global_importance(spark, folder):
    return rounded(explain.global_importance(contributions(spark, folder)))


@query(
    "local_contrib",
    steps("contributions")
    + """SELECT applicant_id, feature, value, round(contribution, 6) AS contribution,
       CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM contributions WHERE applicant_id = 7""",
)
def local_contrib(spark, folder):
    return rounded(explain.local_contributions(contributions(spark, folder), "applicant_id", 7))


@query(
    "reasons",
    steps(
        "scored",
        "contributions",
        ranked="""SELECT applicant_id, row_number() OVER (PARTITION BY applicant_id ORDER BY abs(contribution) DESC, feature) AS rn,
       CASE feature WHEN 'low_credit_score' THEN 'low credit score' WHEN 'low_income' THEN 'low income'
            WHEN 'is_unemployed' THEN 'unemployed' ELSE 'employment is Self-Employed' END
         || CASE WHEN contribution > 0 THEN ' (+)' ELSE ' (-)' END AS reason FROM contributions""",
    )
    + """SELECT s.applicant_id AS applicant_id, any_value(CASE WHEN p >= 0.5 THEN 'approved' ELSE 'declined' END) AS decision,
       any_value(round(p, 3)) AS probability, string_agg(reason, '; ' ORDER BY rn) AS reasons
FROM scored s JOIN ranked r ON s.applicant_id = r.applicant_id WHERE rn <= 3 GROUP BY s.applicant_id""",
)
def reasons(spark, folder):
    return explain.decision_reasons(
        contributions(spark, folder), scored(spark, folder), "applicant_id"
    )


@query(
    "beeswarm_rows",
    steps(
        "contributions",
        top="""SELECT feature, avg(abs(contribution)) AS m FROM contributions GROUP BY feature
ORDER BY round(avg(abs(contribution)), 12) DESC, feature LIMIT 3""",
    )
    + """SELECT c.applicant_id AS applicant_id, c.feature AS feature, value, round(contribution, 6) AS contribution,
       round(m, 6) AS mean_abs_contribution FROM contributions c JOIN top t ON c.feature = t.feature""",
)
def beeswarm_rows(spark, folder):
    return rounded(explain.beeswarm_rows(contributions(spark, folder), 3))


@query(
    "dependence_rows",
    steps("contributions")
    + """SELECT a.applicant_id AS applicant_id, a.value AS value, round(a.contribution, 6) AS contribution, b.value AS colour_value
FROM contributions a JOIN contributions b ON a.applicant_id = b.applicant_id
WHERE a.feature = 'low_credit_score' AND b.feature = 'is_unemployed'""",
)
def dependence_rows(spark, folder):
    return rounded(
        explain.dependence_rows(
            contributions(spark, folder), "applicant_id", "low_credit_score", "is_unemployed"
        )
    )


# Rankings whose three families are measured directly on the table, so that SQL can repeat them:
# information, strength of linear correlation, and share of the most frequent value.

RANKED = [*ALL_NUMERIC]
_family_sql = per_column(
    RANKED,
    """SELECT '{c}' AS feature, round(avg(CASE WHEN LoanApproved = 1 THEN {c} END) / avg({c}), 6) AS mutual_information,
       round(abs(corr(CAST({c} AS DOUBLE), LoanApproved)), 6) AS model_gain,
       CAST(count(DISTINCT {c}) AS DOUBLE) AS permutation FROM engineered""",
)
RANK_SQL = per_column(
    selection.FAMILIES,
    """coalesce((count(*) OVER () - (rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0))
       / nullif(count(*) OVER () - 1, 0), 1) AS {c}_rank""",
    ",\n",
)


def families(spark, folder):
    """Three scores per feature from one pass over the table."""
    frame = fixtures.engineered(spark, folder)
    row = frame.agg(
        *[
            F.struct(
                F.round(
                    F.avg(F.when(F.col(TARGET) == 1, F.col(c))) / F.avg(c), 6
                ).alias("mutual_information"),
                F.round(F.abs(F.corr(F.col(c).cast("double"), TARGET)), 6).alias("model_gain"),
            ).alias(c)
            for c in RANKED
        ],
        *[F.count_distinct(c).cast("double").alias(f"d_{c}") for c in RANKED],
    )
    entries = [
        (F.lit(c), F.col(f"{c}.mutual_information"), F.col(f"{c}.model_gain"), F.col(f"d_{c}"))
        for c in RANKED
    ]
    return stacked(row, entries, ("feature", *selection.FAMILIES))


@query(
    "rank_consensus",
    steps("engineered", families=_family_sql, ranked=f"SELECT *, {RANK_SQL} FROM families")
    + """SELECT feature, mutual_information, model_gain, permutation, round(mutual_information_rank, 6) AS mutual_information_rank,
       round(model_gain_rank, 6) AS model_gain_rank, round(permutation_rank, 6) AS permutation_rank,
       round((mutual_information_rank + model_gain_rank + permutation_rank) / 3, 6) AS consensus FROM ranked""",
)
def rank_consensus(spark, folder):
    return rounded(selection.rank_consensus(families(spark, folder)))


# A curve over a growing number of score cut-offs stands in for a fitted selection curve.
_curve_sql = """SELECT k, round(avg(a), 4) AS mean, round(stddev_pop(a), 4) AS std
FROM (SELECT b.k AS k, c.f AS f, avg(CAST(CASE WHEN p >= b.k / 12.0 THEN y = 1 ELSE y = 0 END AS INTEGER)) AS a
      FROM (SELECT CAST(i AS INTEGER) AS k FROM range(1, 13) r(i)) b, (SELECT p, y, applicant_id % 5 AS f FROM scored) c
      GROUP BY b.k, c.f) t GROUP BY k"""


def accuracy_curve(spark, folder):
    """Mean and deviation over five groups of the accuracy at twelve cut-offs, in one pass."""
    table = scored(spark, folder)
    right = [
        F.avg(((F.col("p") >= F.lit(k) / 12.0) == (F.col("y") == 1)).cast("int")).alias(f"a{k}")
        for k in range(1, 13)
    ]
    groups = table.groupBy((F.col("applicant_id") % 5).alias("f")).agg(*right)
    row = groups.agg(
        *[F.round(F.avg(f"a{k}"), 4).alias(f"m{k}") for k in range(1, 13)],
        *[F.round(F.stddev_pop(f"a{k}"), 4).alias(f"s{k}") for k in range(1, 13)],
    )
    entries = [(F.lit(k), F.col(f"m{k}"), F.col(f"s{k}")) for k in range(1, 13)]
    return stacked(row, entries, ("k", "mean", "std"))


@query(
    "one_se_rule",
    steps("scored", curve=_curve_sql, best="SELECT * FROM curve ORDER BY mean DESC, k LIMIT 1")
    + """SELECT min(c.k) AS selected_k, max(b.k) AS best_k FROM curve c, best b WHERE c.mean >= b.mean - b.std / sqrt(5)""",
)
def one_se_rule(spark, folder):
    return selection.one_standard_error(accuracy_curve(spark, folder))


@query(
    "marked_selection_curve",
    steps(
        "scored",
        curve=_curve_sql,
        best="SELECT * FROM curve ORDER BY mean DESC, k LIMIT 1",
        chosen="SELECT min(c.k) AS sk FROM curve c, best b WHERE c.mean >= b.mean - b.std / sqrt(5)",
    )
    + "SELECT c.k AS k, c.mean AS mean, c.std AS std, c.k = b.k AS is_best, c.k = sk AS is_selected FROM curve c, best b, chosen",
)
def marked_selection_curve(spark, folder):
    return selection.marked_curve(accuracy_curve(spark, folder))
