import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from adjudica.functions import ordering


def skewed(seed=1, rows=4000):
    """A third of all rows share one value."""
    random = np.random.default_rng(seed)
    values = np.round(random.gamma(1.5, 40.0, rows), 2)
    values[: rows // 3] = 17.5
    return pd.DataFrame({"x": values, "w": random.integers(0, 2, rows)})


def test_quantiles_equal_numpy_on_a_skewed_column(spark):
    table = skewed()
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    frame = spark.createDataFrame(table)
    spread = ordering.quantile_row(frame, ["x", "w"], shares).first()
    for c in ("x", "w"):
        expected = np.quantile(table[c], shares)
        assert np.allclose(spread[c], expected, rtol=1e-12)


def test_columns_without_values_have_no_quantiles(spark):
    frame = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    row = ordering.quantile_row(frame, ["a", "b"], [0.5]).first()
    assert row["a"] == [2.0] and row["b"] is None


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_pandas(spark, descending):
    table = skewed(2)
    counted = ordering.count_values(spark.createDataFrame(table), [], "x")
    got = ordering.running_totals(counted, [], "x", ["n"], descending).toPandas()
    want = table.groupby("x").size().sort_index(ascending=not descending)
    before = (want.cumsum() - want).to_dict()
    assert len(got) == len(want)
    assert all(before[x] == b for x, b in zip(got["x"], got["before_n"]))
    assert (got["all_n"] == len(table)).all()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.floats(0, 1))
def test_any_quantile_of_any_list(spark, values, share):
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = ordering.quantile_row(frame, ["x"], [share]).first()["x"][0]
    assert got == pytest.approx(np.quantile(values, share), abs=1e-9)


def test_more_buckets_than_values(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        table = skewed(3, 300)
        frame = spark.createDataFrame(table)
        got = ordering.quantile_row(frame, ["x"], [0.1, 0.9]).first()["x"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(got, np.quantile(table["x"], [0.1, 0.9]))


def test_brackets_leave_out_nearly_all_rows(spark):
    """Above the size that is taken whole, rows below a bracket are one row and those above none."""
    table = skewed(4, 60_000)
    frame = spark.createDataFrame(table).repartition(7)
    shares = [0.0, 0.001, 0.2, 0.5, 0.9, 1.0]
    got = ordering.quantile_row(frame, ["x", "w"], shares).first()
    for c in ("x", "w"):
        assert np.allclose(got[c], np.quantile(table[c], shares), rtol=1e-12)


def test_quantiles_of_subsets_in_one_call(spark):
    from pyspark.sql import functions as F

    table = skewed(5, 3000)
    frame = spark.createDataFrame(table)
    parts = {"ones": F.when(F.col("w") == 1, F.col("x")), "none": F.when(F.col("w") == 9, F.col("x"))}
    row = ordering.bracketed_quantiles(frame, parts, [0.5]).first()
    assert row["ones"][0] == pytest.approx(np.median(table["x"][table["w"] == 1])) and row["none"] is None


def test_quantiles_move_no_row_by_its_value(spark):
    """The only exchanges are those of counts inside the brackets."""
    frame = spark.range(100).selectExpr("cast(id as double) as x", "cast(id % 7 as double) as y")
    plan = ordering.quantile_row(frame, ["x", "y"], [0.25, 0.5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "BroadcastHashJoin" not in plan
