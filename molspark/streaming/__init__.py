"""Streams of arriving read files.

The row-local read and cassette operators hold no aggregation, so they run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of reads as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is there to Parquet, once each, and stop."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
