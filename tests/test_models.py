import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from adjudica.operators import detectors, preprocess, rankings, tree_contributions, tuning, validation
from adjudica.operators import autoencoder
from adjudica.operators.autoencoder import Autoencoder
from adjudica.operators.classifiers import ModelKind, UnknownModelError, get_model, score_rows
from adjudica.operators.metrics import score_report
from adjudica.plans import training
from adjudica.sources import fixtures, runs, tables
from adjudica.spec import APPLICANTS, ENGINEERED
from adjudica.streaming import scoring
from tests.brute_force import shapley

NUMERIC, CATEGORICAL = ENGINEERED.split_types(ENGINEERED.candidates)
LINEAR = validation.ModelPlan(
    "LoanApproved", tuple(NUMERIC), tuple(CATEGORICAL), "logistic_regression"
)
BOOSTED = validation.ModelPlan(
    "LoanApproved", tuple(NUMERIC), tuple(CATEGORICAL), "sampled_boosting",
    {"maxIter": 3, "maxDepth": 3},
)


def test_unknown_names_list_the_choices():
    with pytest.raises(UnknownModelError, match="logistic_regression, random_forest"):
        get_model("nothing")
    with pytest.raises(detectors.UnknownDetectorError, match="isolation_forest, one_class_svm"):
        detectors.get_detector("nothing")


def test_a_model_without_probabilities_is_refused(spark):
    from pyspark.ml.regression import LinearRegression

    kind = ModelKind("wrong", lambda params, rows: LinearRegression(), {})
    with pytest.raises(TypeError, match="probabilities"):
        kind.estimator({}, 10)


def test_scaling_fills_with_the_median_and_centres(spark, engineered):
    model = preprocess.MedianScaler(["Income", "Age"]).fit(engineered)
    out = model.transform(engineered)
    row = out.agg(
        F.avg("Income__scaled"), F.stddev_pop("Income__scaled"), F.count_if(F.col("Income__filled").isNull())
    ).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and row[2] == 0
    filled = out.where("Income is null").select("Income__filled").distinct().collect()
    values = [r[0] for r in engineered.where("Income is not null").select("Income").collect()]
    assert len(filled) == 1 and filled[0][0] == pytest.approx(np.median(values))


def test_unseen_category_is_all_zeros_and_missing_is_a_level(spark):
    from pyspark.ml import Pipeline

    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    model = Pipeline(stages=preprocess.category_stages(["c"])).fit(train)
    assert list(model.stages[1].labelsArray[0]) == ["Missing", "a", "b"]
    new = spark.createDataFrame([("zzz",), (None,), ("a",)], "c string")
    got = [list(r[0]) for r in model.transform(new).select(vector_to_array("c__hot")).collect()]
    assert got == [[0, 0, 0], [1, 0, 0], [0, 1, 0]]


def test_model_ranks_well_saves_and_loads(spark, engineered, tmp_path):
    train, held = engineered.where("fold > 0"), engineered.where("fold = 0")
    model = LINEAR.fit(train)
    report = score_report(score_rows(model, held), y="LoanApproved").first()
    assert report["roc_auc"] > 0.8
    runs.save_model(model, str(tmp_path / "m"))
    again = runs.load_model(str(tmp_path / "m"))
    both = score_rows(again, score_rows(model, held.drop("LoanApproved"), "a"), "b")
    assert both.where("a <> b").count() == 0


def test_cross_validation_repeats(engineered):
    first = validation.cross_validate(engineered, LINEAR, 3)
    again = validation.cross_validate(engineered, LINEAR, 3)
    assert first["folds"] == pytest.approx(again["folds"], abs=1e-9)
    assert len(first["folds"]) == 3 and 0.5 < first["mean"] <= 1


def test_out_of_fold_scores_every_row_once(engineered):
    scored = validation.out_of_fold(engineered, LINEAR, 3, ["applicant_id"])
    assert scored.count() == engineered.count() == scored.select("applicant_id").distinct().count()


def test_calibration_keeps_probabilities_and_improves_brier(engineered):
    model = validation.calibrate(engineered, LINEAR, 3)
    smooth = model.score(engineered)
    limits = smooth.agg(F.min("p"), F.max("p")).first()
    assert 0 <= limits[0] <= limits[1] <= 1
    plain = score_report(score_rows(LINEAR.fit(engineered), engineered), y="LoanApproved").first()
    after = score_report(smooth, y="LoanApproved").first()
    assert after["brier_score"] < plain["brier_score"]


@pytest.mark.parametrize("name", ["sampled_boosting", "random_forest"])
def test_contributions_equal_enumerated_shapley_values(spark, engineered, name):
    params = {"maxIter": 2, "maxDepth": 3} if name == "sampled_boosting" else {"numTrees": 3, "maxDepth": 4}
    plan = validation.ModelPlan("LoanApproved", ("CreditScore", "Income", "Age"), ("EmploymentType",), name, params)
    model = plan.fit(engineered)
    leaves = tree_contributions.model_leaves(model, spark)
    rows = model.transform(engineered).select(vector_to_array("features")).limit(5).collect()
    x = np.array([r[0] for r in rows])
    size = x.shape[1]
    got = tree_contributions.contributions_of(leaves, x)
    for row, parts in zip(x, got):

        def value(known):
            total = 0.0
            for leaf in leaves:
                weight = leaf.value
                for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                    weight *= float(low < row[f] <= high) if f in known else share
                total += weight
            return total

        assert np.allclose(parts, shapley(value, size), atol=1e-10)


def test_long_paths_take_the_pattern_route(spark):
    random = np.random.default_rng(0)
    size = 9
    leaf = tree_contributions.Leaf(
        np.arange(size), np.full(size, -np.inf), np.zeros(size), random.uniform(0.2, 0.9, size), 2.0
    )
    x = random.normal(size=(20, size))
    got = tree_contributions.contributions_of([leaf], x)
    passed = (x <= 0).astype(float)
    full = 2.0 * passed.prod(axis=1) - 2.0 * leaf.share.prod()
    assert np.allclose(got.sum(axis=1), full)


def test_path_tables_of_many_leaves_add_up_leaf_by_leaf():
    """Blocks of leaves, short and long paths and shared features give the sums of single leaves."""
    random = np.random.default_rng(1)
    leaves = []
    for _ in range(300):
        size = int(random.integers(0, 9))
        features = np.sort(random.choice(12, size, replace=False))
        low = random.normal(-1, 1, size)
        leaves.append(tree_contributions.Leaf(features, low, low + 2, random.uniform(0.1, 1, size), random.normal()))
    x = random.normal(size=(2100, 12))
    alone = sum(tree_contributions.contributions_of([leaf], x[-60:]) for leaf in leaves)
    assert np.allclose(tree_contributions.contributions_of(leaves, x)[-60:], alone, atol=1e-12)
    passed = lambda leaf: ((x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)).all(axis=1)
    margin = sum(leaf.value * (passed(leaf) - leaf.share.prod()) for leaf in leaves)
    assert np.allclose(tree_contributions.contributions_of(leaves, x).sum(axis=1), margin)


def test_explanations_add_up_and_show_unscaled_values(spark, engineered):
    model = BOOSTED.fit(engineered)
    long, base = tree_contributions.explain_model(model, engineered, "applicant_id")
    sums = long.groupBy("applicant_id").agg(F.sum("contribution").alias("s"))
    raw = model.transform(engineered).select("applicant_id", vector_to_array("rawPrediction")[1].alias("r"))
    worst = sums.join(raw, "applicant_id").agg(F.max(F.abs(F.col("s") + base - F.col("r")))).first()[0]
    assert worst < 1e-9
    shown = long.where("feature = 'CreditScore'").join(engineered, "applicant_id")
    assert shown.where("CreditScore is not null and abs(value - CreditScore) > 1e-9").count() == 0
    reasons = tree_contributions.explain_decisions(model, engineered, "applicant_id", 0.5).collect()
    assert len(reasons) == engineered.count()
    assert all(r["reasons"].count(";") == 2 for r in reasons)


def test_isolation_forest_and_boundary_find_a_planted_outlier(spark):
    random = np.random.default_rng(4)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(random.normal(size=(800, 2)))]
    rows.append((9999, [9.0, -9.0]))
    encoded = spark.createDataFrame(rows, "k long, x array<double>")
    for score in (detectors.isolation_score(encoded, "k"), detectors.one_class_score(encoded, 0.02)):
        top = encoded.select("k", score.alias("s")).orderBy(F.desc("s")).limit(8).collect()
        assert 9999 in [r["k"] for r in top]


def test_each_tree_of_a_large_table_gets_its_own_bounded_rows(spark):
    encoded = spark.range(200000).select("id", F.array(F.rand(1)).alias("x"))
    counts = detectors.tree_samples(encoded, "id", 200000, 42).groupBy("tree").count().collect()
    assert len(counts) == detectors.TREES
    assert all(detectors.TREE_ROWS < r["count"] < 2 * detectors.TREE_ROWS for r in counts)


def test_detectors_flag_the_asked_share(spark, engineered):
    flagged = detectors.model_flags(engineered, APPLICANTS, 0.02)
    shares = flagged.agg(*[F.avg(F.col(n).cast("int")) for n in sorted(detectors.DETECTORS)]).first()
    assert all(abs(s - 0.02) < 0.004 for s in shares)


def test_a_shuffled_column_keeps_its_values_and_others_stay(spark, engineered):
    columns = ["Income", "Education"]
    frame = engineered.select("applicant_id", *columns)
    copies = rankings.shuffled_copies(frame, "applicant_id", columns, 2, 1, 3)
    part = copies.where("feature = 'Income' and repeat = 1")
    assert part.select("Income").exceptAll(frame.select("Income")).count() == 0
    assert frame.select("Income").exceptAll(part.select("Income")).count() == 0
    assert part.select("applicant_id", "Education").exceptAll(frame.select("applicant_id", "Education")).count() == 0
    moved = part.join(frame.withColumnRenamed("Income", "old"), "applicant_id").where("not Income <=> old").count()
    assert moved > 0.8 * frame.count()


def test_permutation_finds_the_deciding_columns(engineered):
    found = rankings.permutation_ranking(
        engineered, ENGINEERED, ["Age", "Income", "CreditScore", "EmploymentType"],
        "logistic_regression", repeats=2,
    )
    order = [r["feature"] for r in found.orderBy(F.desc("permutation")).collect()]
    assert order[-1] == "Age"


def test_search_is_repeatable_and_inside_its_space(spark):
    first = tuning.draw_params("sampled_boosting", 5, 1)
    assert first == tuning.draw_params("sampled_boosting", 5, 1) != tuning.draw_params("sampled_boosting", 5, 2)
    for params in first:
        for name, space in get_model("sampled_boosting").space.items():
            assert space.low <= params[name] <= space.high
    trials = spark.createDataFrame(
        [(0, 0.5, {"maxDepth": 4.0}), (1, 0.9, {"maxDepth": 7.0})],
        "number int, value double, params map<string,double>",
    )
    assert tuning.best_params(trials, "sampled_boosting") == {"maxDepth": 7}


def test_embedding_is_repeatable_nonnegative_and_reduces_error(spark, engineered):
    columns = ["Age", "LoanAmount", "CreditScore"]
    scaled = preprocess.MedianScaler(columns).fit(engineered).transform(engineered)
    inputs = [c + preprocess.SCALED for c in columns]
    short, long = Autoencoder(inputs, 2, steps=1), Autoencoder(inputs, 2, steps=15)
    short.train(scaled)
    weights = long.train(scaled)
    assert long.reconstruction_error < short.reconstruction_error
    again = Autoencoder(inputs, 2, steps=15)
    assert all(np.allclose(a[0], b[0]) for a, b in zip(weights, again.train(scaled)))
    out = long.fit(scaled).transform(scaled)
    assert long.names == ["autoencoder_0", "autoencoder_1"]
    assert out.where("autoencoder_0 < 0 or autoencoder_1 < 0").count() == 0


def test_network_steps_reach_the_network_and_end_when_the_loss_stays(spark):
    rows = [(float(k % 7 - 3), float((k * k) % 5 - 2)) for k in range(70)]
    frame = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    plain = preprocess.preprocessor(["a", "b"], [], 1).getStages()[1]
    assert plain.steps == 500
    few = preprocess.preprocessor(["a", "b"], [], 1, network_steps=7).getStages()[1]
    assert few.steps == 7 and validation.ModelPlan("y", ("a",), (), network_steps=7).network_steps == 7
    still = Autoencoder(["a", "b"], 1, steps=60, rate=0.0)
    still.train(frame)
    assert still.steps_taken == 10
    short, long = Autoencoder(["a", "b"], 1, steps=20), Autoencoder(["a", "b"], 1, steps=60)
    short.train(frame)
    long.train(frame)
    assert long.steps_taken > 20 and long.reconstruction_error < short.reconstruction_error


def test_stream_scores_equal_batch_scores(spark, small, engineered, tmp_path):
    model = LINEAR.fit(engineered)
    rows = tables.project_features(fixtures.repaired(spark, small), APPLICANTS)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scoring.score_stream(scoring.read_stream(spark, str(tmp_path / "in")), model)
    scoring.write_scores(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = score_rows(model, engineered, "b").select("applicant_id", "b")
    both = got.join(batch, "applicant_id")
    assert both.count() == engineered.count()
    assert both.where("abs(ApprovalProbability - b) > 1e-12").count() == 0


def test_stages_run_from_a_raw_file_to_an_evaluated_model(spark, small, tmp_path):
    raw = str(tmp_path / "raw.csv")
    tables.write_csv(fixtures.applicants(spark, small), raw)
    place = training.Workspace(raw, str(tmp_path / "work"))
    done = training.run_stages(
        spark, place, name="logistic_regression", options=training.TrainingOptions(folds=2)
    )
    assert list(done) == list(training.STAGES)
    trained, evaluated = done["train"].first(), done["evaluate"].first()
    assert evaluated["roc_auc"] > 0.8
    # The evaluation derives the same holdout and threshold again.
    assert evaluated["average_precision"] == pytest.approx(trained["average_precision"])
    assert evaluated["threshold"] == trained["threshold"]
    model = runs.load_model(place.model)
    out = training.explain_file(spark, model, raw, str(tmp_path / "why"), 0.5, limit=20)
    assert out.count() == 20
    scored = training.score_file(spark, model, raw, str(tmp_path / "scores"), 0.5)
    assert scored.count() == 1500


def test_figure_tables_of_a_tuned_run(spark, small):
    outcome = training.run_training(
        fixtures.repaired(spark, small),
        "logistic_regression",
        training.TrainingOptions(tune=True, trials=2, folds=2, remove_outliers=False),
    )
    found = training.figure_tables(outcome, folds=2, sizes=2)
    assert {"tuning_history", "param_effect", "roc_points", "learning_curve"} <= set(found)
    assert all(table.count() > 0 for table in found.values())


def test_linear_explanation_of_one_row_is_that_of_the_whole_table(engineered):
    model = LINEAR.fit(engineered)
    key = engineered.agg(F.min("applicant_id")).first()[0]
    one = engineered.where(F.col("applicant_id") == key)
    whole, base = tree_contributions.explain_model(model, engineered, "applicant_id")
    alone, base_alone = tree_contributions.explain_model(model, one, "applicant_id")
    wanted = {r["feature"]: r["contribution"] for r in whole.where(F.col("applicant_id") == key).collect()}
    found = {r["feature"]: r["contribution"] for r in alone.collect()}
    assert base == base_alone and found == wanted and any(found.values())


def test_queries_of_models_ask_for_the_whole_job(spark, small, monkeypatch):
    """The queries hand over all candidates and no folds, trials or parameters of their own."""
    import inspect

    from adjudica.operators import rankings, tuning, validation
    from adjudica.plans import model_queries, training
    from adjudica.spec import ENGINEERED, KNOBS

    asked = {}

    def record(module, name):
        signature = inspect.signature(getattr(module, name))

        def take(*args, **named):
            bound = signature.bind(*args, **named)
            bound.apply_defaults()
            asked[name] = bound.arguments
            raise InterruptedError

        monkeypatch.setattr(module, name, take)

    watched = {
        "model_comparison": (validation, "compare_models"),
        "tuned": (tuning, "tune"),
        "selection_curve": (rankings, "selection_curve"),
        "feature_ranking": (rankings, "rank_features"),
        "training_run": (training, "run_training"),
    }
    for query, (module, name) in watched.items():
        record(module, name)
        with pytest.raises(InterruptedError):
            getattr(model_queries, query)(spark, small)
    assert asked["compare_models"]["folds"] == asked["tune"]["folds"] == KNOBS.folds
    assert asked["compare_models"]["params"] is None and asked["tune"]["trials"] == KNOBS.trials
    assert asked["selection_curve"]["folds"] == KNOBS.folds
    for name in ("selection_curve", "rank_features"):
        columns = next(v for v in asked[name].values() if isinstance(v, list))
        assert columns == ENGINEERED.candidates
    options = asked["run_training"].get("options")
    assert options is None or options.folds == KNOBS.folds
    assert model_queries.BOOSTED.params is None
    assert tuple(model_queries.ONE_HOT) == ENGINEERED.categorical


def test_network_sums_in_blocks_equal_those_of_single_rows(spark, monkeypatch):
    """Packed blocks, several tasks and short parts give the sums of the rows, and the gradient is that of the loss."""
    source = np.random.default_rng(5)
    x = source.normal(size=(700, 3))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3)
    monkeypatch.setattr(autoencoder, "PART_ROWS", 64)
    shapes = autoencoder._shapes(3, 4, 2)
    flat = source.normal(size=sum(r * c + c for r, c in shapes))
    blocks = autoencoder._packed(frame)
    assert blocks.count() < 700
    sums = autoencoder._summed(blocks, flat, shapes)

    def loss(at):
        h = x
        for i, (weights, bias) in enumerate(autoencoder._unpack(at, shapes)):
            h = h @ weights + bias
            h = h if i == 3 else np.maximum(h, 0.0)
        return ((h - x) ** 2).mean(axis=1).sum()

    assert sums[:2] == pytest.approx([loss(flat), 700])
    steps = np.eye(flat.size) * 1e-6
    slopes = [(loss(flat + s) - loss(flat - s)) / 2e-6 for s in steps]
    assert sums[2:] == pytest.approx(slopes, rel=1e-4, abs=1e-4)


def test_boundary_of_a_larger_table_starts_from_a_part_and_uses_all_rows(spark, monkeypatch):
    """The solver gets a part alone, and the scores rank the rows as those of the solver over all rows do."""
    from adjudica.session import materialize

    rows = materialize(
        spark.range(6000).select(
            "id", F.array(F.randn(1), F.randn(2) * 2, (F.randn(3) > 1).cast("double")).alias("x")
        )
    )
    taken, solver = [], detectors.LinearSVC

    class Counted(solver):
        def fit(self, dataset, params=None):
            taken.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(detectors, "LinearSVC", Counted)
    monkeypatch.setattr(detectors, "START_ROWS", 1500)
    scores = []
    for limit in (200_000, 3000):
        monkeypatch.setattr(detectors, "WHOLE_ROWS", limit)
        found = rows.select("id", detectors.one_class_score(rows).alias("s")).orderBy("id").collect()
        scores.append([r["s"] for r in found])
    assert taken[0] == 12_000 and 0 < taken[1] < 5_000
    assert np.corrcoef(scores)[0, 1] > 0.97


def test_newton_steps_reach_the_lowest_hinge_loss(monkeypatch):
    """From a poor start: a loss that no random step near the end lowers."""
    random = np.random.default_rng(5)
    x = random.normal(size=(3000, 2))
    directions = random.normal(size=(2, detectors.COMPONENTS))
    shifts = random.uniform(0.0, 6.28, detectors.COMPONENTS)
    z = detectors._lifted(x, directions, shifts)
    assert np.allclose(z, np.sqrt(2 / detectors.COMPONENTS) * np.cos(x @ directions + shifts), atol=1e-12)
    center = z.mean(axis=0)
    loss = lambda w: np.maximum(1.0 - z @ w, 0.0).mean() + 0.01 / 2.0 * (w @ w)
    start = center / (center @ center)
    monkeypatch.setattr(
        detectors, "_task_sums", lambda blocks, columns, part_of: sum(part_of(x[i : i + 1000]) for i in (0, 1000, 2000))
    )
    end, scans = detectors._boundary(None, 3000, start, 0.3, 0.01, directions, shifts)
    assert scans > 1 and loss(end) < loss(start)
    for size in (1e-1, 1e-2):
        for _ in range(200):
            assert loss(end + size * random.normal(size=len(end)) / len(end) ** 0.5) > loss(end) * (1 - 1e-4)
