"""Every registered query against the same in SQL, and the stated cases against their answers."""

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from __spark_entry__ import catalog  # noqa: E402  all plans are registered there

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple("NULL" if pd.isna(x) else str(x.date()) if isinstance(x, pd.Timestamp) and x == x.normalize() else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = [[tuple(str(float(x)) if x.replace(".", "", 1).lstrip("-").isdigit() else x for x in r) for r in rows(d)] for d in (got, want)]
    assert a == b


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_case(spark, duck, name):
    case, answer = cases.CASES[name]
    same(case(catalog.Tables(spark, DIR)).toPandas(), duck.execute(answer).df())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_reads_tables(spark, name):
    """Every plan has a scan of files, not literal rows."""
    plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan
