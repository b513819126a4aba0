"""Arrow IPC files: types, runs of batches, streams, commits; SQL-defined functions."""

import datetime
import os

import pyarrow as pa
import pytest
from pyarrow import ipc
from pyspark.sql import functions as F

from molspark.functions import sql
from molspark.plans.queries import QUERIES
from molspark.sources.arrow_files import arrow_scan, arrow_sink


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_round_trip_equals_parquet(spark, tmp_path):
    df = spark.range(0, 3000, 1, 5).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("text"), F.expr("cast(id as decimal(20, 3)) as dec"), F.expr("date_add(date'2020-01-01', cast(id as int)) as day"),
        F.expr("timestamp_micros(id * 1000003) as ts"), F.expr("cast(timestamp_micros(id) as timestamp_ntz) as ntz"), F.expr("array(id, null) as a"), F.expr("map('k', id) as m"),
        F.expr("named_struct('x', id, 'y', 'z') as s"), F.expr("cast(text as binary) as b"), F.expr("id % 2 = 0 as even"))
    arrow_sink(df, str(tmp_path / "x"))
    df.write.parquet(str(tmp_path / "p"))
    back = arrow_scan(spark, str(tmp_path / "x"), range_bytes=20_000)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
    assert rows_of(back) == rows_of(spark.read.parquet(str(tmp_path / "p")))
    assert back.rdd.getNumPartitions() > 5
    some = arrow_scan(spark, str(tmp_path / "x"), ["text", "id"])
    assert some.columns == ["text", "id"] and rows_of(some) == rows_of(df.select("text", "id"))


@pytest.mark.parametrize("range_bytes", [2500, 1 << 30])
def test_every_batch_is_read_once(spark, tmp_path, range_bytes):
    """Batches of other engines: dictionaries, views, unsigned integers; a stream beside files; a column that one file lacks."""
    t = pa.table({"n": pa.array(range(1000), pa.uint32()), "word": pa.array(["a", "b", None, "c"] * 250).dictionary_encode(), "big": pa.array(["x"] * 1000, pa.large_string()),
                  "list": pa.array([[1], [], None, [2, 3]] * 250, pa.large_list(pa.uint8())), "when": pa.array([datetime.datetime(2020, 1, 1)] * 1000, pa.timestamp("ns"))})
    with ipc.new_file(tmp_path / "a.arrow", t.schema) as f:
        f.write_table(t, 7)
    with ipc.new_stream(tmp_path / "b.arrows", t.schema) as f:
        f.write_table(t, 100)
    with ipc.new_file(tmp_path / "c.arrow", t.select(["n"]).schema) as f:
        f.write_table(t.select(["n"]), 100)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "d.arrow").write_bytes(b"no table")
    got = arrow_scan(spark, str(tmp_path), range_bytes=range_bytes)
    assert got.schema.simpleString() == "struct<n:bigint,word:string,big:string,list:array<smallint>,when:timestamp_ntz>"
    assert sorted(r.n for r in got.select("n").collect()) == sorted([*range(1000)] * 3)
    want = [(r["n"], r["word"], r["big"], r["list"], r["when"]) for r in t.to_pylist()]
    assert sorted(map(tuple, got.where("big is not null").collect()), key=lambda r: r[0]) == sorted(want * 2, key=lambda r: r[0])


def test_no_rows_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "x")
    arrow_sink(spark.range(10).where("id < 0"), path)
    assert arrow_scan(spark, path).count() == 0 and arrow_scan(spark, path).columns == ["id"]
    arrow_sink(spark.range(10), path, compression="none")
    arrow_sink(spark.range(5), path, compression="lz4")
    assert sorted(r.id for r in arrow_scan(spark, path).collect()) == sorted([*range(10), *range(5)])
    arrow_sink(spark.range(3), path, "overwrite")
    assert sorted(r.id for r in arrow_scan(spark, path).collect()) == [0, 1, 2]
    assert all(f.endswith(".arrow") for f in os.listdir(path))
    with pytest.raises(Exception, match="nowhere"):
        arrow_scan(spark, str(tmp_path / "nowhere"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    """Three tasks write, the fourth fails late: what stood there before stays as it was."""
    path = str(tmp_path / "x")
    arrow_sink(spark.range(5), path)
    before = sorted(os.listdir(path))
    bad = spark.range(0, 40_000, 1, 4).select(F.expr("if(id = 39999, raise_error('late'), id) as id").cast("long"))
    with pytest.raises(Exception, match="late"):
        arrow_sink(bad, path, "overwrite")
    assert sorted(os.listdir(path)) == before and arrow_scan(spark, path).count() == 5


def test_sql_functions(spark):
    assert set(sql.register(spark)) == {"reverse_complement", "hamming", "mean_quality", "gc_share", "kmers", "between_anchors"}
    got = spark.sql("""SELECT reverse_complement(a), hamming(a, b), mean_quality(q), gc_share(a), kmers(a, 3), between_anchors(a, 'AC', 'N')
        FROM VALUES ('ACGTN', 'ACGTA', 'II5'), ('AC', 'A', ''), ('', '', NULL), (NULL, 'A', 'I'), ('NAC', 'NAC', '!!!') AS t(a, b, q)""").collect()
    assert list(map(tuple, got)) == [("NACGT", 1, 100 / 3, 0.4, ["ACG", "CGT", "GTN"], "GT"), ("GT", None, None, 0.5, [], None), ("", 0, None, None, [], None),
                                     (None, None, 40.0, None, None, None), ("GTN", 0, 0.0, 1 / 3, ["NAC"], None)]


def test_sql_text_holds_no_python(spark, small):
    plan = QUERIES["sql_text_functions"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
