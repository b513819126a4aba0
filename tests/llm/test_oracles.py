"""The queries of the training-data operators that have SQL, against DuckDB over whole tables."""

import duckdb
import pytest

from molspark.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import TABLES
from ..test_oracles import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    q = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
