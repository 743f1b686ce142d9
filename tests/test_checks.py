"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    from checks.compare import compare

    assert compare(spark, connection, SF_DIR, name).startswith(("ok", "rows"))


def test_entry(spark):
    assert entry.entry(spark).columns == ["job_id", "workspace_id", "status", "started_ms", "finished_ms", "inserted_ms"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
