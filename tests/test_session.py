from types import SimpleNamespace

import pytest

from adjudica import session


def pretend(master, folder=None):
    """A session that names a folder or none."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: folder),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_the_cluster_names_the_folder():
    assert session.shared_folder(pretend("spark://host", "hdfs://shared/x/")) == "hdfs://shared/x"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(pretend("spark://host"))


def test_a_local_session_keeps_one_folder_of_its_own():
    assert session.shared_folder(pretend("local[2]")) == session.shared_folder(pretend("local[2]"))


def test_materialized_rows_are_read_back_with_their_types(spark):
    frame = spark.createDataFrame([(1, None, "a")], "k long, x double, c string")
    stored = session.materialize(frame)
    assert stored.schema == frame.schema and stored.collect() == frame.collect()
