import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from adjudica.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def engineered(spark):
    """The small engineered table with three folds, stored once."""
    from adjudica.operators.splits import assign_folds
    from adjudica.session import materialize
    from adjudica.sources.fixtures import engineered as build
    from adjudica.spec import ENGINEERED

    return materialize(assign_folds(build(spark, SMALL), ENGINEERED, 3))
