import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.operators import errors, explain, fairness, metrics, selection


def scored(spark, rows=600, seed=3):
    random = np.random.default_rng(seed)
    y = random.integers(0, 2, rows)
    p = np.clip(np.round(0.3 * y + 0.7 * random.random(rows), 2), 0, 1)
    data = [
        (i, int(a), float(b), "A" if i % 3 else "B", float(i % 7))
        for i, (a, b) in enumerate(zip(y, p))
    ]
    return spark.createDataFrame(data, "k long, y long, p double, g string, x double")


def test_average_precision_of_a_known_case(spark):
    frame = spark.createDataFrame(
        [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5), (0, 0.4)], "y long, p double"
    )
    row = metrics.ranking_metrics(frame).first()
    assert row["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    assert row["roc_auc"] == pytest.approx(7 / 9)


def test_costlier_false_approvals_raise_the_threshold(spark):
    frame = scored(spark)
    best = lambda a, r: metrics.best_threshold(
        metrics.cost_curve(frame, a, r)
    ).first()["threshold"]
    assert best(20.0, 1.0) > best(1.0, 20.0)
    assert best(0.0, 1.0) == pytest.approx(0.05)


def test_cost_curve_equals_direct_counts_at_every_threshold(spark):
    frame = scored(spark)
    pairs = [(r["y"], r["p"]) for r in frame.collect()]
    rows = metrics.cost_curve(frame).collect()
    assert len(rows) == 91
    for row in rows:
        t = row["threshold"]
        assert row["false_approvals"] == sum(p >= t and y == 0 for y, p in pairs)
        assert row["false_rejections"] == sum(p < t and y == 1 for y, p in pairs)


def test_report_counts_reconcile_and_empty_rates_are_zero(spark):
    frame = scored(spark)
    row = metrics.score_report(frame, 0.5).first()
    cells = [row[c] for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")]
    assert sum(cells) == frame.count()
    nobody = metrics.threshold_metrics(frame, 2.0).first()
    assert (nobody["precision"], nobody["recall"], nobody["f1"]) == (0.0, 0.0, 0.0)


def test_error_tables_reconcile(spark):
    classified = errors.classify(scored(spark))
    summary = errors.error_summary(classified).collect()
    assert [r["outcome"] for r in summary] == list(errors.OUTCOMES)
    assert sum(r["count"] for r in summary) == 600
    wrong = classified.where("is_error").count()
    parts = errors.segment_errors(classified, ["g"]).collect()
    assert sum(r["applicants"] * r["error_rate"] for r in parts) == pytest.approx(wrong)
    worst = errors.confident_mistakes(classified, "k", 5).collect()
    assert len(worst) == 5 and all(r["is_error"] for r in worst)
    assert worst[0]["confidence_error"] == max(
        r[0] for r in classified.where("is_error").select("confidence_error").collect()
    )
    density = errors.error_histogram(classified, 10).groupBy("is_error").agg(F.sum("n")).collect()
    assert sum(r[1] for r in density) == 600


def test_all_outcomes_are_reported_even_if_absent(spark):
    frame = spark.createDataFrame([(1, 0.9)], "y long, p double")
    rows = errors.error_summary(errors.classify(frame)).collect()
    assert [r["count"] for r in rows] == [0, 0, 0, 1]


def test_fairness_ratio_lies_in_its_interval_and_repeats(spark):
    classified = errors.classify(scored(spark))
    first = fairness.impact_interval(classified, "g", 200).first()
    again = fairness.impact_interval(classified.repartition(5), "g", 200).first()
    assert first == again
    assert first["lower_95"] <= first["impact_ratio"] <= first["upper_95"]
    assert first["conclusive"] == (first["upper_95"] < 0.8)


def test_nobody_selected_gives_ratio_zero(spark):
    classified = errors.classify(scored(spark), threshold=2.0)
    row = fairness.disparate_impact(fairness.fairness_audit(classified, ["g"])).first()
    assert row["impact_ratio"] == 0.0 and not row["passes_four_fifths"]


def test_normalised_ranks_average_ties(spark):
    frame = spark.createDataFrame(
        [("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", 0.0)], "feature string, s double"
    )
    ranks = dict(frame.select("feature", selection.normalised_rank("s")).collect())
    assert ranks["a"] == ranks["c"] == pytest.approx(2.5 / 3) and ranks["d"] == 0.0
    single = spark.createDataFrame([("a", 3.0)], "feature string, s double")
    assert single.select(selection.normalised_rank("s")).first()[0] == 1.0


def test_one_standard_error_rule(spark):
    curve = spark.createDataFrame(
        [(1, 0.70, 0.02), (2, 0.795, 0.02), (3, 0.80, 0.02), (4, 0.80, 0.02)],
        "k int, mean double, std double",
    )
    row = selection.one_standard_error(curve).first()
    assert (row["selected_k"], row["best_k"]) == (2, 3)


@pytest.mark.parametrize(
    "name, source, text",
    [
        ("CreditScore", "CreditScore", "credit score"),
        ("EmploymentType_Self-Employed", "EmploymentType", "employment is Self-Employed"),
        ("credit_band_near_prime", "credit_band", "credit band is near prime"),
        ("income_missing", "income_missing", "missing income"),
        ("Income_high", "Income", "income is high"),
        ("other_column", "other_column", "other column"),
    ],
)
def test_readable_names(spark, name, source, text):
    row = spark.createDataFrame([(name,)], "f string").select(explain.readable(F.col("f"))).first()
    assert row[0] == text == explain.slot_label(name, source)
