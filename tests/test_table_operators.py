import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adjudica.operators import association, features, outliers, profile, quality, splits
from adjudica.spec import APPLICANTS, ENGINEERED

COLUMNS = (
    "applicant_id long, Age long, Income double, LoanAmount double, CreditScore double, "
    "YearsExperience long, Gender string, Education string, City string, EmploymentType string, "
    "LoanApproved long"
)


def one(spark, **values):
    row = dict(
        applicant_id=1, Age=40, Income=50000.0, LoanAmount=10000.0, CreditScore=700.0,
        YearsExperience=10, Gender="Male", Education="Masters", City="EAST",
        EmploymentType="Salaried", LoanApproved=1,
    )
    row.update(values)
    frame = spark.createDataFrame([tuple(row.values())], COLUMNS)
    return features.engineer(frame).first()


def test_negatives_are_counted_and_repaired(spark):
    frame = spark.createDataFrame(
        [(-1.0, 10.0), (5.0, -2.0), (-3.0, 4.0)], "Income double, LoanAmount double"
    )
    assert tuple(quality.count_impossible(frame, ["Income", "LoanAmount", "Other"]).first()) == (2, 1)
    repaired = quality.repair_impossible(frame, ["Income", "LoanAmount"])
    assert {tuple(r) for r in repaired.collect()} == {(None, 10.0), (5.0, None), (None, 4.0)}
    assert frame.where("Income < 0").count() == 2


def test_missing_score_is_low_but_missing_income_is_not(spark):
    row = one(spark, CreditScore=None, Income=None)
    assert (row["low_credit_score"], row["credit_score_missing"]) == (1, 1)
    assert (row["low_income"], row["income_missing"]) == (0, 1)
    assert row["debt_to_income"] is None and row["credit_score_x_employed"] is None


def test_missing_employment_counts_as_employed(spark):
    assert one(spark, EmploymentType=None)["is_unemployed"] == 0
    row = one(spark, EmploymentType="Unemployed", CreditScore=800.0)
    assert (row["is_unemployed"], row["credit_score_x_employed"]) == (1, 0.0)


def test_debt_ratio_is_finite_and_capped(spark):
    assert one(spark, Income=0.0, LoanAmount=1000.0)["debt_to_income"] == 5.0
    assert one(spark, Income=129.0, LoanAmount=23617.0)["debt_to_income"] == 5.0
    assert one(spark, Income=0.0, LoanAmount=2.0)["debt_to_income"] == 2.0


def test_age_zero_gives_no_ratio(spark):
    assert one(spark, Age=0)["experience_per_age"] is None


@pytest.mark.parametrize(
    "score, expected",
    [(0.0, None), (500.0, "poor"), (500.5, "fair"), (580.0, "fair"), (670.0, "near_prime"),
     (740.0, "prime"), (850.0, "super_prime"), (851.0, None), (None, None)],
)
def test_bands_are_right_closed(spark, score, expected):
    assert one(spark, CreditScore=score)["credit_band"] == expected


def test_duplicate_rows_count_nulls_as_equal(spark):
    frame = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, "b", 1), (4, "a", None)], "k long, c string, v int"
    )
    assert tuple(profile.overview(frame, "k").first()) == (4, 2, 2)


def test_cramers_v_of_equal_and_constant_columns(spark):
    frame = spark.createDataFrame(
        [("x", "k", 1), ("y", "k", 0)] * 20, "same string, constant string, t long"
    )
    found = dict(association.cramers_v(frame, ["same", "constant"], "t").collect())
    assert found["same"] == pytest.approx(1.0) and found["constant"] == 0.0


def test_correlation_ratio_of_separated_and_constant_values(spark):
    frame = spark.createDataFrame(
        [("low", 1.0, 3.0), ("low", 1.0, 3.0), ("high", 9.0, 3.0), ("high", 9.0, 3.0)],
        "g string, x double, c double",
    )
    found = dict(association.correlation_ratio(frame, "g", ["x", "c"]).collect())
    assert found["x"] == pytest.approx(1.0) and found["c"] == 0.0


def test_spearman_with_a_hot_value_equals_pandas(spark):
    random = np.random.default_rng(5)
    table = pd.DataFrame({"a": random.normal(size=3000), "b": random.normal(size=3000)})
    table["b"] += table["a"]
    table.loc[:1200, "a"] = 0.25
    table["c"] = (random.random(3000) < 0.3).astype(float)
    table.loc[table.index % 11 == 0, "b"] = None
    got = association.spearman(spark.createDataFrame(table), ["a", "b", "c"]).collect()
    want = table.corr(method="spearman")
    assert len(got) == 3
    for left, right, value in got:
        assert value == pytest.approx(want.loc[left, right], abs=1e-9)


@pytest.mark.parametrize("block", [association.BLOCK, 7])
def test_nearest_neighbour_information_equals_brute_force(spark, monkeypatch, block):
    from tests.brute_force import neighbour_information

    monkeypatch.setattr(association, "BLOCK", block)
    random = np.random.default_rng(9)
    table = pd.DataFrame({"x": random.normal(size=300), "tied": random.integers(0, 9, 300) * 1.0})
    table["t"] = (table["x"] + random.normal(size=300) > 0.4).astype(int)
    frame = spark.createDataFrame(table)
    got = dict(association.neighbour_information(frame, ["x", "tied"], "t").collect())
    for c in ("x", "tied"):
        want = neighbour_information(table[c].to_numpy(), table["t"].to_numpy(), 3)
        assert got[c] == pytest.approx(want, abs=1e-9)


def test_flags_of_nothing_agree_fully_and_agreement_is_symmetric(spark):
    frame = spark.createDataFrame(
        [(True, False, False), (True, True, False), (False, False, False)],
        "a boolean, b boolean, c boolean",
    )
    found = {(r[0], r[1]): r[2] for r in outliers.flag_jaccard(frame, ["a", "b", "c"]).collect()}
    assert found[("a", "a")] == 1.0 and found[("c", "c")] == 1.0
    assert found[("a", "b")] == found[("b", "a")] == 0.5


def test_rules_flag_planted_outliers_and_never_nulls(spark):
    rows = [(i, float(i % 10), 1.0, 0) for i in range(100)]
    rows += [(100, 500.0, 1.0, 1), (101, None, -4.0, 0)]
    frame = spark.createDataFrame(rows, "k long, x double, m double, t long")
    from adjudica.spec import TableSpec

    spec = TableSpec("k", "t", ("x",), (), nonnegative=("m",))
    flagged = {r["k"]: r for r in outliers.rule_flags(frame, spec).collect()}
    assert flagged[100]["iqr"] and flagged[100]["zscore"] and not flagged[100]["impossible"]
    assert flagged[101]["impossible"] and not flagged[101]["iqr"]
    voted = outliers.consensus(outliers.rule_flags(frame, spec), outliers.RULES)
    listed = outliers.flagged_rows(voted, outliers.RULES).collect()
    assert [(r["k"], r["flagged_by"]) for r in listed] == [(100, "iqr, zscore")]
    assert outliers.remove_flagged(voted).count() == 101


def test_splits_are_repeatable_disjoint_and_stratified(spark, engineered):
    train, holdout = splits.split_holdout(engineered, ENGINEERED)
    assert train.count() + holdout.count() == engineered.count()
    assert train.join(holdout, "applicant_id").count() == 0
    again = splits.split_holdout(engineered.repartition(7), ENGINEERED)[1]
    assert again.select("applicant_id").exceptAll(holdout.select("applicant_id")).count() == 0
    exact = splits.assign_folds(engineered.drop("fold"), ENGINEERED, 5, exact=True)
    counts = exact.groupBy("LoanApproved").pivot("fold").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in counts)


def test_sensitive_columns_are_never_candidates():
    assert not set(ENGINEERED.candidates) & {"Gender", "City"}
    assert APPLICANTS.split_types(["City", "Age"]) == (["Age"], ["City"])


def test_engineering_does_not_look_at_other_rows_or_the_target(spark, engineered):
    base = engineered.select(*[c.split()[0] for c in COLUMNS.split(", ")])
    part = features.engineer(base.where("applicant_id < 200").withColumn("LoanApproved", F.lit(0)))
    whole = features.engineer(base).where("applicant_id < 200")
    assert part.drop("LoanApproved").exceptAll(whole.drop("LoanApproved")).count() == 0
