"""Every query with an oracle SQL matches DuckDB on the small test tables.

Columns are compared by name, rows as multisets; floats within 1e-6 relative.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from frames import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, f"{x:.5g}" if isinstance(x, (int, float)) else str(x)) for x in row)


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return abs(float(a) - float(b)) <= 1e-6 * max(1.0, abs(float(a)), abs(float(b)))
    return a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    scols = sdf.columns
    srows = [tuple(_norm(v) for v in r) for r in sdf.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = [tuple(_norm(v) for v in r) for r in res.fetchall()]
    assert sorted(scols) == sorted(dcols)
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    s = sorted((tuple(r[i] for i in order) for r in srows), key=_key)
    d = sorted((tuple(r[i] for i in dorder) for r in drows), key=_key)
    assert len(s) == len(d)
    bad = [(a, b) for a, b in zip(s, d) if not all(_close(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:3]


def test_every_query_has_a_docstring():
    for name, fn in entry.queries().items():
        assert fn.__doc__, name


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert len(df.columns) > 100
    assert df.count() > 0
