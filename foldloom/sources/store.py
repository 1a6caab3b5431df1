"""Storing packets or samples by identity and day, and reading them back with pruning; replay as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.sources import scratch

BY = ("network", "station", "day")


def write(rows: DataFrame, path: str, by: Sequence[str] = BY, mode: str = "append") -> None:
    """Parquet folders by the given columns. Rows are hashed by them first, so a folder gets few files; a folder too large for one
    task is split by a rebalance.
    """
    rows.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str, condition: Column | None = None) -> DataFrame:
    """Stored rows; a condition on the folder columns reads only those folders."""
    rows = spark.read.parquet(path)
    return rows if condition is None else rows.where(condition)


def with_day(rows: DataFrame, us: Column) -> DataFrame:
    return rows.withColumn("day", F.date_format(F.timestamp_micros(us), "yyyy-MM-dd"))


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Stored files as a stream, oldest first, a few each batch: recorded packets played back at the pace of the query."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").parquet(path)


def by_arrival(rows: DataFrame, arrival_us: Column, every_us: int) -> DataFrame:
    """rows with the number of the batch in which each would have come, for a replay with latencies."""
    return rows.withColumn("batch", F.floor(arrival_us / every_us).cast("long"))


class BatchSink:
    """A sink of a streaming query whose writes can be repeated: batch n goes into folder batch=n, and counts once its mark is in the commit list.

    Each row is stored as a value part and a fold part under one template of folders (kind, then `by`), as wave files keep data and folds apart. A batch that
    is marked is not written again; one that broke down before its mark is written anew. Use it in foreachBatch.
    """

    def __init__(self, path: str, by: Sequence[str] = ("station",)):
        self.path, self.by = path, tuple(by)

    def _mark(self, spark: SparkSession, number: int) -> tuple[object, object]:
        return scratch.place(spark, f"{self.path}/_commits/{number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        mark, files = self._mark(batch.sparkSession, number)
        if files.exists(mark):
            return
        kinds = F.explode(F.array(F.struct(F.lit("value").alias("kind"), F.col("value").cast("double").alias("x")), F.struct(F.lit("fold").alias("kind"), F.col("fold").cast("double").alias("x"))))
        rows = batch.withColumn("part_", kinds).select(*[c for c in batch.columns if c not in ("value", "fold")], "part_.*")
        write(rows, f"{self.path}/batch={number}", ("kind", *self.by), "overwrite")
        files.create(mark, True).close()

    def committed(self, spark: SparkSession) -> list[int]:
        """The numbers of the batches that count."""
        mark, files = scratch.place(spark, f"{self.path}/_commits")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(mark)) if files.exists(mark) else []

    def read(self, spark: SparkSession, keys: Sequence[str] = ("id", "idx")) -> DataFrame:
        """keys, value and fold of all rows of the batches that count; keys tell rows of a batch apart."""
        numbers = self.committed(spark)
        if not numbers:
            raise ValueError(f"nothing is stored in {self.path}")
        rows = spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in numbers])
        x = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("x"))).alias(kind)
        return rows.groupBy("batch", *keys).agg(x("value"), x("fold")).drop("batch")
