"""Every query with SQL against DuckDB on the smallest tables; the rest runs."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("SMOKE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    got = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(entry.queries().keys() - entry.oracle_sql().keys()))
def test_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_llm_is_a_leaf():
    from pathlib import Path

    root = Path(entry.__file__).parent / "benchloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "benchloom.llm" not in p.read_text()
