from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from agorametric.operators.cells import Cells  # noqa: E402
from agorametric.plans.cleaning import clean  # noqa: E402
from agorametric.session import local_session  # noqa: E402
from agorametric.schemas import RAW  # noqa: E402
from agorametric.sources.sample_posts import sample_raw  # noqa: E402

DATA = Path("/root/testdata")
SMALL = str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.fixture(scope="session")
def sample(spark):
    """Staging rows of the smallest sample."""
    return sample_raw(spark, SMALL)


@pytest.fixture(scope="session")
def posts(spark, sample, tmp_path_factory):
    """Clean rows of the smallest sample, stored."""
    path = str(tmp_path_factory.mktemp("posts") / "clean")
    clean(sample).write.parquet(path)
    return Cells.of_rows(spark.read.parquet(path))


@pytest.fixture(scope="session")
def raw_rows(spark):
    """Builds staging rows from dicts; what a row leaves out has a valid value."""
    usual = {
        "created_at": "2012-03-04 05:06:07+00:00",
        "lng": None,
        "lat": None,
        "topic": "Politics",
        "sentiment": "0.1",
        "stance": "believer",
        "gender": "male",
        "temperature_avg": None,
        "aggressiveness": "not aggressive",
    }

    def build(*rows):
        full = [{"id": at, **usual, **row} for at, row in enumerate(rows, start=1)]
        return spark.createDataFrame([tuple(row[name] for name in RAW.names) for row in full], RAW)

    return build


@pytest.fixture(scope="session")
def cells_of(raw_rows):
    return lambda *rows: Cells.of_rows(clean(raw_rows(*rows)))


def rows_of(frame, *order):
    found = [row.asDict() for row in frame.collect()]
    return sorted(found, key=lambda row: tuple(str(row[name]) for name in order)) if order else found


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
