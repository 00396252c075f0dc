import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseflow.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
ZERO = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return ZERO + dt.timedelta(microseconds=round(hours * 3_600_000_000))


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "caseflow-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Make every key with more than two rows a hot key."""
    spark.conf.set("spark.caseflow.hotRows", "2")
    yield
    spark.conf.unset("spark.caseflow.hotRows")


@pytest.fixture(scope="session")
def moves(spark):
    """rows: (hadm_id, careunit, start hour, end hour or None) -> transfers in the given order."""

    def build(rows, kind="transfer"):
        schema = "hadm_id BIGINT, event_id BIGINT, careunit STRING, eventtype STRING, intime TIMESTAMP_NTZ, outtime TIMESTAMP_NTZ"
        data = [
            (case, i, unit, kind, at(a), None if b is None else at(b)) for i, (case, unit, a, b) in enumerate(rows)
        ]
        return spark.createDataFrame(data, schema)

    return build


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
