"""Registered queries against their SQL counterparts on the smallest sample tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import worksight_sql
from scripts.compare import KINDS, TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'"
        )
    return connection


OWN = sorted(worksight_sql.statements())


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.queries())
    assert set(OWN) == {q for q in entry.queries() if q not in entry._llm_queries()}


def test_sql_needs_no_spark_installation(tmp_path):
    """The statements come from plain text: no jar, no session, no other package file."""
    code = (
        "import pyspark; pyspark.__file__ = '%s/__init__.py'; import worksight_sql; "
        "print(len(worksight_sql.statements()))" % tmp_path
    )
    root = os.path.dirname(os.path.abspath(worksight_sql.__file__))
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120
    )
    assert done.stdout.split()[-1] == "53", done.stderr


@pytest.mark.parametrize("name", OWN)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    columns = list(types)
    assert types == {c: KINDS.get(t, t) for c, t in df.dtypes}
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id", "category", "risk_score", "risk_level", "risk_reasons"]
    assert df.count() == 10
