"""Running a stream over what has arrived, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_at_once: int | None = None) -> DataFrame:
    """The Parquet files that arrive in a folder, as a stream: those that are there, then those that come; each is read once.
    Without files_at_once, all that have arrived make one batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that has arrived, append its rows to a table at path, and return that table.

    checkpoint holds how far the stream has read, its watermark and its state: the next run with it goes on from there, and
    one that was stopped or lost its executors repeats no row, as the table's log knows the batches that are whole. Both
    paths are in storage that the cluster shares.
    """
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
