from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tallyloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Build a domain table from tuples under its declared schema."""
    from tallyloom.sources.schemas import TABLE_SCHEMAS

    def build(name: str, rows, columns: str | None = None):
        frame = spark.createDataFrame([tuple(r) for r in rows], columns or TABLE_SCHEMAS[name])
        return frame

    return build
