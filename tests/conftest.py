from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stepledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(**{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="stepledger-tests-")})
    yield session
    session.stop()


@pytest.fixture
def wrong(spark):
    """Rows of ``(inputs…, expected)`` for which a column gives something else."""

    def find(rows, schema, column):
        df = spark.createDataFrame(rows, schema).withColumn("got", column)
        return [row for row in df.collect() if row["got"] != row["expected"]]

    return find
