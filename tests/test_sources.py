import pytest
from pyspark.sql import functions as F

from adjudica.plans import training
from adjudica.sources import catalog, fingerprints, fixtures, runs, tables
from adjudica.spec import APPLICANTS

HEADER = "applicant_id,Age,Income,LoanAmount,CreditScore,YearsExperience,Gender,Education,City,EmploymentType,LoanApproved"


def write_csv(folder, *lines):
    path = folder / "in.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_csv_is_typed_and_every_missing_spelling_is_null(spark, tmp_path):
    path = write_csv(
        tmp_path,
        "1,30,NA,2000.5,NaN,4,Male,,EAST,Salaried,1",
        "2,41.0,50000,-1,700,9,Female,NA,WEST,Unemployed,0",
    )
    frame = tables.read_table(spark, path, APPLICANTS)
    first, second = frame.orderBy("applicant_id").collect()
    assert (first["Income"], first["CreditScore"], first["Education"]) == (None, None, None)
    assert second["Education"] is None and second["Age"] == 41
    assert dict(frame.dtypes)["Income"] == "double" and dict(frame.dtypes)["Age"] == "bigint"


def test_null_in_a_whole_number_column_is_refused(spark, tmp_path):
    path = write_csv(tmp_path, "1,,5,2000,600,4,Male,Masters,EAST,Salaried,1")
    frame = tables.check_whole_numbers(tables.read_table(spark, path, APPLICANTS), APPLICANTS)
    with pytest.raises(Exception, match="whole-number column Age"):
        frame.collect()


def test_missing_columns_are_all_named(spark):
    frame = spark.createDataFrame([(1, 2.0)], "applicant_id long, Income double")
    with pytest.raises(tables.MissingColumnsError, match="scores.*Age.*LoanAmount"):
        tables.require_columns(frame, ["Age", "Income", "LoanAmount"], "scores")


def test_scoring_input_drops_other_columns_and_needs_no_target(spark, small, tmp_path):
    rows = fixtures.applicants(spark, small).drop("LoanApproved").withColumn("extra", F.lit(1))
    path = str(tmp_path / "new.parquet")
    tables.write_parquet(rows, path)
    assert tables.scoring_input(spark, path, APPLICANTS).columns == [
        "applicant_id",
        *APPLICANTS.features,
    ]


def test_training_input_prefers_path_then_processed_then_repaired_raw(spark, tmp_path):
    raw = write_csv(tmp_path, "1,30,-5,2000,600,4,Male,Masters,EAST,Salaried,1")
    processed = str(tmp_path / "p.parquet")
    repaired = tables.training_input(spark, APPLICANTS, processed=processed, raw=raw)
    assert repaired.first()["Income"] is None
    given = tables.training_input(spark, APPLICANTS, path=raw)
    assert given.first()["Income"] == -5
    tables.write_parquet(repaired.withColumn("Age", F.lit(99).cast("long")), processed)
    stored = tables.training_input(spark, APPLICANTS, processed=processed, raw=raw)
    assert stored.first()["Age"] == 99


def test_fingerprint_ignores_order_but_not_repeats(spark):
    frame = spark.range(50).withColumn("v", F.col("id") % 7)
    digest = lambda f: fingerprints.table_fingerprint(f).first()["sha256"]
    assert digest(frame) == digest(frame.orderBy(F.desc("id")).repartition(3))
    assert digest(frame) != digest(frame.union(frame.limit(1)).union(frame.limit(1)))
    assert digest(frame) != digest(frame.withColumn("v", F.lit(0)))


def test_file_fingerprint_is_the_sha256_of_the_bytes(spark, tmp_path):
    import hashlib

    path = tmp_path / "f.bin"
    path.write_bytes(b"some bytes")
    found = fingerprints.file_fingerprints(spark, str(path)).first()
    assert found["sha256"] == hashlib.sha256(b"some bytes").hexdigest()


def test_dataset_log_keeps_every_stage_and_the_newest_entry(spark, small, tmp_path):
    raw, log = str(tmp_path / "raw.csv"), str(tmp_path / "log")
    tables.write_csv(fixtures.applicants(spark, small), raw)
    prepared = catalog.prepare(spark, raw, str(tmp_path / "p.parquet"), log)
    catalog.preprocess(prepared, str(tmp_path / "q.parquet"), log)
    catalog.preprocess(prepared.limit(10), str(tmp_path / "q.parquet"), log)
    rows = {r["stage"]: r for r in catalog.latest_stages(spark, log).collect()}
    assert set(rows) == {"raw", "processed", "preprocessed"}
    assert rows["preprocessed"]["n_rows"] == 10 and len(rows["preprocessed"]["derived"]) == 10
    assert rows["processed"]["n_rows"] == 1500


def test_run_id_depends_on_inputs_only():
    base = {"model_name": "m", "features": ["a", "b"], "params": {"C": 1.0}, "data": "x"}
    assert runs.run_id(base) == runs.run_id({**base, "features": ["b", "a"]})
    assert runs.run_id(base) != runs.run_id({**base, "params": {"C": 2.0}})
    assert len(runs.run_id(base)) == 12


def test_run_index_keeps_earlier_runs_and_replaces_repeats(spark, tmp_path):
    index = str(tmp_path / "runs")
    for name, score in (("one", 0.5), ("two", 0.6), ("one", 0.7)):
        described = runs.manifest(name, {}, ["a"], 0.5, {}, {}, "data")
        runs.record_run(spark, described, {"average_precision": score, "roc_auc": 0.5}, index)
    rows = {r["model_name"]: r for r in runs.run_index(spark.read.parquet(index)).collect()}
    assert len(rows) == 2 and rows["one"]["average_precision"] == 0.7
    assert rows["one"]["is_current"] and not rows["two"]["is_current"]


def test_unknown_stage_lists_the_stages(spark, tmp_path):
    place = training.Workspace("raw.csv", str(tmp_path))
    with pytest.raises(training.UnknownStageError, match="prepare, preprocess, train, evaluate"):
        training.run_stages(spark, place, "deploy")
