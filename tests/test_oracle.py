"""Every core query that has oracle SQL, against DuckDB on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from chunkloom.plans.core_queries import ORACLE, QUERIES


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.6g}"
    return str([value(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    r = db.execute(ORACLE[name])
    cols = [c[0] for c in r.description]
    want = r.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert bag(df.columns, df.collect()) == bag(cols, want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
