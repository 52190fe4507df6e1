"""Tables that a job writes to the cluster's shared folder and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session in one process may do without: it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts the lineage, survives the loss of executors, fixes row ids that were made on the way, and gives the
    planner the true size of the table, by which it decides whether a join may broadcast it.
    """
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path with all below it, by the file system that it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def unstage(*frames: DataFrame) -> None:
    """Delete what staged() wrote. Only for tables that nothing reads any more."""
    for df in frames:
        root = stage_root(df.sparkSession).rpartition(":")[2].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if root in folder:
                delete(df.sparkSession, folder)
