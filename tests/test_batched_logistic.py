"""Regressions fitted together against single pipelines and direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.functions.subsets import added_moments, cell_moments, subset_medians
from adjudica.operators import batched_logistic, batched_permutation, fold_networks, preprocess, rankings, tuning, validation
from adjudica.operators.autoencoder import Autoencoder
from adjudica.operators.batched_logistic import Fit, fit_batch
from adjudica.operators.classifiers import score_rows
from adjudica.operators.metrics import ranking_metrics
from adjudica.spec import ENGINEERED

TARGET = ENGINEERED.target
PLAN = validation.ModelPlan(TARGET, ("Age", "Income", "CreditScore"), ("Education", "credit_band"), "logistic_regression")


def test_scores_equal_those_of_single_pipelines(engineered):
    """Spark's own solver, run to a tight tolerance, reaches the same optimum in every fold."""
    exact = validation.ModelPlan(PLAN.target, PLAN.numeric, PLAN.categorical, PLAN.name, {"C": 0.3, "tol": 1e-12})
    ours = validation.ModelPlan(PLAN.target, PLAN.numeric, PLAN.categorical, PLAN.name, {"C": 0.3})
    assert validation.in_one_batch(ours) and not validation.in_one_batch(exact)
    left = {r[0]: r[1:] for r in validation.out_of_fold(engineered, exact, 3, ["applicant_id"]).collect()}
    right = {r[0]: r[1:] for r in validation.out_of_fold(engineered, ours, 3, ["applicant_id"]).collect()}
    assert left.keys() == right.keys() and len(left) == engineered.count()
    assert all(left[k][:2] == right[k][:2] and abs(left[k][2] - right[k][2]) < 1e-6 for k in left)


def test_gradients_vanish_for_every_penalty_and_subset(engineered):
    cells = [frozenset([0, 1]), frozenset([2]), frozenset([0, 1, 2])]
    fits = [Fit(PLAN.numeric[:n], PLAN.categorical[: n - 1], c, s) for n in (1, 2, 3) for c in cells for s in (1e-3, 1.0, 1e2)]
    batch = fit_batch(engineered, TARGET, "fold", fits)
    assert np.nanmax(batch.gradients) < 1e-6 and batch.scans <= 12


@pytest.mark.parametrize("cells", [[frozenset([0]), frozenset([0, 1, 2])], [frozenset([9])]])
def test_medians_and_moments_of_subsets(spark, cells):
    source = np.random.default_rng(1)
    x = source.gamma(1.5, 40.0, 30_000).round(2)
    x[:10_000] = 17.5
    cell = source.integers(0, 3, len(x))
    frame = spark.createDataFrame([(float(v), int(c), None) for v, c in zip(x, cell)], "x double, cell int, none double")
    moments = cell_moments(frame, "cell", ["x", "none"])
    got = subset_medians(frame, "cell", ["x", "none"], cells, moments)
    for subset, (median, nothing) in zip(cells, got):
        chosen = x[np.isin(cell, list(subset))]
        assert np.isnan(nothing)
        if not len(chosen):
            assert np.isnan(median)
            continue
        assert median == pytest.approx(np.median(chosen), abs=1e-12)
        count, mean, variance = added_moments([moments[c] for c in subset])[0]
        assert (count, mean, variance) == pytest.approx((len(chosen), chosen.mean(), chosen.var()))


def test_a_median_outside_the_first_brackets_is_found(spark):
    """Cells that are not random parts of the table: their medians lie far from its middle."""
    frame = spark.range(60_000).select(F.col("id").cast("double").alias("x"), F.floor(F.col("id") / 20_000).cast("int").alias("cell"))
    moments = cell_moments(frame, "cell", ["x"])
    got = subset_medians(frame, "cell", ["x"], [frozenset([0]), frozenset([2])], moments)
    assert got.ravel().tolist() == [9999.5, 49999.5]


ODD = [(1, 1.0, "a", 0, 0), (2, None, None, 1, 0), (3, 5.0, "b", 0, 1), (4, float("nan"), "a", 1, 1), (5, 2.0, "c", None, 0), (6, 2.0, "c", 1, 0)]


def test_odd_rows(spark):
    """Missing values, a class that a subset lacks, a level it has not seen, rows without a target."""
    frame = spark.createDataFrame(ODD, "id int, x double, c string, y int, cell int")
    fits = [Fit(("x",), ("c",), frozenset([0])), Fit((), (), frozenset([0, 1])), Fit(("x",), (), frozenset([7]))]
    batch = fit_batch(frame, "y", "cell", fits)
    everything = frozenset([0, 1])
    scored = batch.score(frame, [(0, everything, ("a",)), (1, everything, ("b",)), (2, everything, ("c",))], ["id"], "which string").collect()
    assert len(scored) == 15 and all(0.0 <= r["p"] <= 1.0 for r in scored)
    assert {r["p"] for r in scored if r["which"] == "b"} == {0.5}
    assert {r["p"] for r in scored if r["which"] == "c"} == {0.0}


def test_many_models_read_the_table_few_times(engineered, monkeypatch):
    scans = []
    real = validation.fit_batch
    monkeypatch.setattr(validation, "fit_batch", lambda *a: scans.append(real(*a)) or scans[-1])
    trials = tuning.tune(engineered, PLAN, trials=6, folds=3).collect()
    assert len(trials) == 6 and len(scans) == 1 and scans[0].scans <= 10 and len(scans[0].fits) == 18
    curve = rankings.selection_curve(engineered, ENGINEERED, ["CreditScore", "Education", "Age"], "logistic_regression", folds=3).collect()
    alone = validation.cross_validate(
        engineered, validation.ModelPlan(TARGET, ("CreditScore",), ("Education",), "logistic_regression"), 3
    )
    assert curve[1]["mean"] == round(alone["mean"], 4) and len(scans) == 3


def test_learning_curve_of_one_batch_equals_single_fits(engineered):
    few = validation.learning_curve(engineered, PLAN, "applicant_id", 3, 2)
    single = validation.ModelPlan(PLAN.target, PLAN.numeric, PLAN.categorical, PLAN.name, {"tol": 1e-12})
    apart = {(round(r[0], 9), r[1]): r[2:] for r in validation.learning_curve(engineered, single, "applicant_id", 3, 2).collect()}
    for r in few.collect():
        assert r[2:] == pytest.approx(apart[round(r[0], 9), r[1]], abs=1e-6)
    assert len(apart) == 4


def test_a_whole_fit_scores_like_the_pipeline(engineered):
    model = validation.ModelPlan(PLAN.target, PLAN.numeric, PLAN.categorical, PLAN.name, {"tol": 1e-12}).fit(engineered)
    whole = frozenset([0, 1, 2])
    ours = fit_batch(engineered, TARGET, "fold", [Fit(PLAN.numeric, PLAN.categorical, whole)])
    left = {r[0]: r[1] for r in score_rows(model, engineered).select("applicant_id", "p").collect()}
    right = {r[0]: r[2] for r in ours.score(engineered, [(0, whole, ())], ["applicant_id"]).collect()}
    assert max(abs(left[k] - right[k]) for k in left) < 1e-6


def test_embedding_verdict_follows_the_one_standard_error_rule(engineered):
    plan = validation.ModelPlan(TARGET, ("Age", "Income", "CreditScore"), (), "logistic_regression", bottleneck=2, network_steps=3)
    base, coded = validation.embedding_verdict(engineered, plan, 3).collect()
    assert (base["verdict"], base["difference"]) == ("baseline", 0.0)
    assert coded["features"] == "engineered + autoencoder(2)"
    assert coded["difference"] == pytest.approx(coded["cv_pr_auc"] - base["cv_pr_auc"], abs=1e-12)
    assert (coded["verdict"] == "keep") == (coded["difference"] > base["std"] / 3**0.5)


def _entries():
    folds = [frozenset([k]) for k in range(3)]
    fits = [Fit(PLAN.numeric, PLAN.categorical, folds[0] | folds[1], s) for s in (1e-2, 1.0)] + [Fit((), ("Education",), folds[2])]
    asked = [(n, cells, (n, k)) for n in range(3) for k, cells in enumerate([*folds, folds[0] | folds[2], frozenset([9])])]
    return fits, asked


def test_packed_ranks_equal_those_of_scored_rows(engineered, monkeypatch):
    """Many buckets, scores that repeat much, and several rounds of held scores change no result."""
    fits, asked = _entries()
    batch = fit_batch(engineered, TARGET, "fold", fits)
    scored = batch.score(engineered, asked, labels="a int, b int")
    plain = {r[:2]: r[2:] for r in validation.ranking_metrics(scored, keys=["a", "b"]).collect()}
    counts = {r[:2]: r[2] for r in scored.groupBy("a", "b").count().collect()}
    for ranked_at_once, held in ((250_000, 4_000_000), (7, 50)):
        monkeypatch.setattr(batched_logistic, "RANKED_SCORES", ranked_at_once)
        monkeypatch.setattr(batched_logistic, "HELD_SCORES", held)
        packed = batch.ranked(engineered, asked, "a int, b int").collect()
        assert {r[:2] for r in packed} == plain.keys() and len(packed) == 12
        for r in packed:
            assert r["rows"] == counts[r[:2]] and r[3:] == pytest.approx(plain[r[:2]], abs=1e-12)


def test_packed_ranks_of_one_class(spark):
    frame = spark.createDataFrame([(0.0, 0, 0), (1.0, 1, 0), (2.0, 1, 1), (3.0, 1, 1), (4.0, 0, 2), (4.0, None, 2)], "x double, y int, cell int")
    batch = fit_batch(frame, "y", "cell", [Fit(("x",), (), frozenset([0]))])
    asked = [(0, frozenset([k]), (k,)) for k in range(3)]
    got = {r[0]: r[1:] for r in batch.ranked(frame, asked, "k int").collect()}
    assert got == {0: (2, 1.0, 1.0), 1: (2, 1.0, None), 2: (1, None, None)}


def test_a_start_on_few_rows_ends_at_the_same_optimum(engineered, monkeypatch):
    fits, _ = _entries()
    whole = fit_batch(engineered, TARGET, "fold", fits)
    monkeypatch.setattr(batched_logistic, "START_ROWS", engineered.count() // 5)
    begun = fit_batch(engineered, TARGET, "fold", fits)
    # The part depends on how the files are read, so the scans it saves vary.
    assert begun.scans <= whole.scans + 1 and np.nanmax(begun.gradients) < 1e-6
    assert np.abs(begun.coefficients - whole.coefficients).max() < 1e-4


def test_a_calibrated_batch_scores_like_pipelines_of_their_own(engineered, monkeypatch):
    """Also rows with null, NaN and unseen inputs; no pipeline is fitted above the limit of rows."""
    exact = validation.ModelPlan(PLAN.target, PLAN.numeric, PLAN.categorical, PLAN.name, {"C": 0.3, "tol": 1e-12})
    ours = validation.ModelPlan(PLAN.target, PLAN.numeric, PLAN.categorical, PLAN.name, {"C": 0.3})
    left = validation.calibrate(engineered, exact, 3)
    monkeypatch.setattr(validation, "APART_ROWS", 10)
    monkeypatch.setattr(validation, "score_rows", None)
    right = validation.calibrate(engineered, ours, 3)
    odd = engineered.withColumn("Education", F.when(F.col("applicant_id") % 3 == 0, "unseen").otherwise(F.col("Education")))
    odd = odd.withColumn("Income", F.when(F.col("applicant_id") % 5 != 0, F.col("Income"))).drop("fold", TARGET)
    monkeypatch.undo()
    a, b = ({r[0]: r[1] for r in m.score(odd).select("applicant_id", "p").collect()} for m in (left, right))
    assert a.keys() == b.keys() and len(a) == engineered.count()
    assert np.mean([abs(a[k] - b[k]) for k in a]) < 1e-4
    nan = right.score(odd.where("Income IS NULL").withColumn("Income", F.lit(float("nan")))).select("applicant_id", "p")
    assert all(abs(b[k] - p) < 1e-12 for k, p in nan.collect())


def test_shuffled_columns_rank_like_copies_of_the_rows(spark, engineered, monkeypatch):
    """The same shifts of the same order; no copy is made above the limit of rows."""
    columns = [*PLAN.numeric, *PLAN.categorical]
    frame = engineered.withColumn(TARGET, F.when(F.col("applicant_id") % 11 != 0, F.col(TARGET)))
    left = rankings.permutation_ranking(frame, ENGINEERED, columns, "logistic_regression", {"C": 0.3}, 3)
    left = {r["feature"]: r["permutation"] for r in left.collect()}
    monkeypatch.setattr(rankings, "COPIED_ROWS", 10)
    monkeypatch.setattr(rankings, "shuffled_copies", None)
    for ranked in (batched_logistic.RANKED_SCORES, 40):
        monkeypatch.setattr(batched_logistic, "RANKED_SCORES", ranked)
        monkeypatch.setattr(batched_permutation, "RANKED_SCORES", ranked)
        right = rankings.permutation_ranking(frame, ENGINEERED, columns, "logistic_regression", {"C": 0.3}, 3)
        right = {r["feature"]: r["permutation"] for r in right.collect()}
        assert left.keys() == right.keys() == set(columns)
        assert all(abs(left[c] - right[c]) < 1e-9 for c in columns)


def test_every_row_is_scored_in_every_shuffle_also_without_a_key_of_its_own(engineered):
    """Null and repeated keys share a bucket of the order; the heads of small buckets follow each other."""
    key = F.when(F.col("applicant_id") % 3 != 0, F.col("applicant_id") % 40)
    frame = engineered.withColumn("applicant_id", key).limit(200)
    model = PLAN.fit(engineered)
    columns = [*PLAN.numeric, *PLAN.categorical]
    held = frame.select("applicant_id", TARGET, *columns).cache()
    found = batched_permutation.permuted_ranks(model, held, "applicant_id", TARGET, columns, 7, 1, 60).collect()
    assert len(found) == 1 + 7 * len(columns) and {r["rows"] for r in found} == {held.count()}
    plain = next(r for r in found if r["feature"] is None)
    scored = ranking_metrics(score_rows(model, held), TARGET).first()
    assert abs(plain["average_precision"] - scored["average_precision"]) < 1e-9


def test_networks_of_all_folds_equal_single_ones(engineered, monkeypatch):
    """One pass per step for all folds gives the weights of single networks, and the scores of single pipelines."""
    inputs = ["Age", "Income", "CreditScore"]
    subsets = [frozenset(range(3)) - {k} for k in range(3)]
    passes = []
    real = fold_networks._evaluate
    monkeypatch.setattr(fold_networks, "_evaluate", lambda *a: passes.append(1) or real(*a))
    together = fold_networks.train_networks(engineered, "fold", inputs, subsets, 2, steps=6)
    assert len(passes) == 6 and together.steps_taken == (6, 6, 6)
    for k, layers in enumerate(together.layers):
        train = engineered.where(F.col("fold") != k)
        scaled = preprocess.MedianScaler(inputs).fit(train).transform(train)
        alone = Autoencoder([c + preprocess.SCALED for c in inputs], 2, steps=6).train(scaled)
        for (w, b), (v, c) in zip(layers, alone):
            assert np.allclose(w, v, atol=1e-9) and np.allclose(b, c, atol=1e-9)
    plan = validation.ModelPlan(TARGET, tuple(inputs), ("Education",), "logistic_regression", bottleneck=2, network_steps=4)
    apart = dict(validation.fold_scores(engineered, plan, 3).select("fold", "average_precision").collect())
    monkeypatch.setattr(validation, "APART_ROWS", 0)
    joined = dict(validation.fold_scores(engineered, plan, 3).select("fold", "average_precision").collect())
    assert apart.keys() == joined.keys() and all(abs(apart[k] - joined[k]) < 5e-3 for k in apart)
