"""Boosted trees grown from stored bins against those of ``pyspark.ml``."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.operators import classifiers, tree_contributions
from adjudica.operators.binned_trees import subset_size, thresholds

EVERY = {"subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "maxDepth": 4}


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    kind = F.when(n % 11 == 0, None).otherwise(F.concat(F.lit("k"), (n * 13 % 5).cast("string")))
    size = F.when(n % 7 != 0, (n * 7919 % 1009).cast("double"))
    other = (n * 104729 % 503) / 10
    y = ((F.coalesce(size, F.lit(300.0)) + 9 * other + F.when(kind == "k2", 400).otherwise(0)) % 900 > 500).cast("long")
    rows = spark.range(3000).select("id", kind.alias("kind"), size.alias("size"), other.alias("other"), y.alias("y"))
    return rows.localCheckpoint()


def fitted(table, monkeypatch, limit, **params):
    monkeypatch.setattr(classifiers, "SCANNED_ROWS", limit, raising=False)
    return classifiers.fit_model(table, "y", ["size", "other"], ["kind"], params=params)


def test_trees_of_bins_equal_those_of_pyspark(table, monkeypatch):
    plain = fitted(table, monkeypatch, 10**9, maxIter=3, **EVERY)
    before = {r["id"]: r["p"] for r in classifiers.score_rows(plain, table).collect()}
    scanned = []
    whole = classifiers.GBTClassifier._fit
    monkeypatch.setattr(classifiers.GBTClassifier, "_fit", lambda self, rows: scanned.append(rows.count()) or whole(self, rows))
    binned = fitted(table, monkeypatch, 0, maxIter=3, **EVERY)
    after = {r["id"]: r["p"] for r in classifiers.score_rows(binned, table).collect()}
    assert scanned == [2]  # the form of a saved model, not the table
    assert binned.stages[-1].getMaxIter() == 3
    assert list(binned.stages[-1].treeWeights) == list(plain.stages[-1].treeWeights)
    assert max(abs(before[k] - after[k]) for k in before) < 1e-9
    gains = [m.stages[-1].featureImportances.toArray() for m in (plain, binned)]
    assert np.allclose(*gains, atol=1e-6)


def test_contributions_add_up_with_drawn_rows_and_features(table, monkeypatch):
    model = fitted(table, monkeypatch, 0, maxIter=3)
    assert 0.8 < classifiers.score_rows(model, table).select(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
    long, base = tree_contributions.explain_model(model, table, "id")
    sums = long.groupBy("id").agg(F.sum("contribution").alias("s"))
    raw = model.transform(table).select("id", "rawPrediction")
    found = {r["id"]: r["rawPrediction"][1] for r in raw.collect()}
    assert all(abs(r["s"] + base - found[r["id"]]) < 1e-9 for r in sums.collect())


def test_thresholds_and_subsets():
    assert thresholds(np.array([1.0, 2.0, 2.0, 4.0]), np.ones(4), 8).tolist() == [1.5, 3.0]
    assert len(thresholds(np.arange(1000.0), np.ones(1000), 64)) == 63
    assert [subset_size(s, 27) for s in ("all", "0.8", "sqrt", "5", "onethird")] == [27, 22, 6, 5, 9]


def test_siblings_share_one_table_and_keep_their_contributions():
    """Leaves reached by opposite tests are one column; one whose feature was tested above keeps its own."""
    leaf = lambda tests, value: tree_contributions.Leaf(
        *(np.array([t[i] for t in tests]) for i in range(4)), value
    )
    inf = np.inf
    pair = [leaf([(0, -inf, 1.0, 0.4), (2, -inf, 0.5, 0.3)], 2.0), leaf([(0, -inf, 1.0, 0.4), (2, 0.5, inf, 0.7)], -1.0)]
    apart = [leaf([(0, 1.0, 2.0, 0.1), (1, -inf, 0.0, 0.6)], 3.0), leaf([(0, 2.0, inf, 0.5), (1, -inf, 0.0, 0.6)], 5.0)]
    tables = tree_contributions.path_tables(pair + apart)
    assert sum(t.features.shape[1] for t in tables) == 3
    x = np.array([[a, b, c] for a in (0.5, 1.0, 1.5, 2.5) for b in (-1.0, 0.0, 1.0) for c in (0.0, 0.5, 1.0)])
    together = tree_contributions.contributions_by_tables(tables, x)
    alone = sum(tree_contributions.contributions_of([one], x) for one in pair + apart)
    assert np.allclose(together, alone, atol=1e-12)
