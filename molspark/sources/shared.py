"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="molspark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only for a local session that names none.

    On a cluster a folder of one machine is no shared one, so there the setting must be made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or _own_folder()).rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """Where this application stores its tables."""
    return f"{shared_dir(spark)}/molspark/{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables that this application has stored.  Call it when results are written: a lazy result may still read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: ends the lineage, so that lost executors recompute nothing before it."""
    path = f"{session_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most 8 MB, so that long ones don't fill a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
