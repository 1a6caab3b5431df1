"""Folders and tables for the time of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, on a master that is one process only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="foldloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def place(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path and the file system that holds it, as the session's Hadoop configuration has them."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder in the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    where, files = place(spark, path)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: cuts the lineage, so that a lost executor costs no recomputation of what made it."""
    path = new_folder(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
