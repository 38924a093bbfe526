import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from gradeloom.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def evaluate(spark):
    """Evaluate a column over literal rows: evaluate("a string", rows, column) -> values."""
    def run(schema, rows, column):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + schema)
        return [r[0] for r in df.orderBy("i").select(column).collect()]
    return run
