import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from taskloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", partitions=4, **{"spark.default.parallelism": "2"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def driver_tables(spark):
    from taskloom.sources.fixtures import from_driver_tables

    return from_driver_tables(spark, SMALL)
