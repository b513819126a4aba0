"""Every query with SQL against DuckDB over a small fixture; test_brute_force.py has the others."""

import datetime
import math

import duckdb
import pytest

from molspark.plans.queries import ORACLE_SQL, QUERIES

from .conftest import TABLES


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return "nan" if math.isnan(v) else round(float(v), 6)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    q = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
    assert ours == theirs
