import os
import sys

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """The smallest tables, cut to a fixture that every oracle test runs over in seconds."""
    folder = tmp_path_factory.mktemp("small")
    for t in TABLES:
        rows = pq.read_table(f"{SF}/{t}.parquet")
        pq.write_table(rows.slice(0, {"lineitem": 700, "orders": 500}.get(t, 1000)), folder / f"{t}.parquet")
    return str(folder)
