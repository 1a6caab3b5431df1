"""Frames over long series without one task for a whole series.

A series is cut into chunks of `length` sample numbers. For operators that look a bounded way back or ahead, each sample
also enters the neighbouring chunks that need it; a window then runs within a chunk, and only a chunk's own samples leave.
Running totals take the chunks' totals as offsets. Runs are paired from their two ends within a chunk, and across chunks from
one row a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTH = 65_536


def chunk(length: int = LENGTH) -> Column:
    return F.floor(F.col("idx") / length).cast("long")


def framed(samples: DataFrame, by: Sequence[str], before: int, after: int, make: Callable[[object], dict[str, Column]], length: int = LENGTH) -> DataFrame:
    """samples with new columns made over a window ordered by idx that sees `before` samples back and `after` ahead."""
    first, last = F.floor((F.col("idx") - after) / length), F.floor((F.col("idx") + before) / length)
    placed = samples.withColumn("chunk_", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*by, "chunk_").orderBy("idx")
    return placed.withColumns(make(window)).where(F.col("chunk_") == chunk(length)).drop("chunk_")


def running_sum(samples: DataFrame, by: Sequence[str], value: Column, name: str, length: int = LENGTH) -> DataFrame:
    """samples with the sum of value over all samples up to each, in order of idx."""
    placed = samples.withColumns({"chunk_": chunk(length), "part_": value})
    own = Window.partitionBy(*by, "chunk_").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*by, "chunk_").agg(F.sum("part_").alias("sum_")).withColumn("offset_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0.0))).drop("sum_")
    totals = placed.withColumn("own_", F.coalesce(F.sum("part_").over(own), F.lit(0.0))).join(offsets, [*by, "chunk_"])
    return totals.withColumn(name, F.col("own_") + F.col("offset_")).drop("chunk_", "part_", "own_", "offset_")


def run_bounds(samples: DataFrame, by: Sequence[str], inside: Column, length: int = LENGTH) -> DataFrame:
    """by, first, last of each run of consecutive sample numbers for which `inside` holds."""
    held = samples.where(inside).select(*by, "idx")
    near = lambda w: {"back": F.lag("idx").over(w), "ahead": F.lead("idx").over(w)}
    edges = framed(held, by, 1, 1, near, length).select(
        *by,
        "idx",
        F.coalesce(F.col("back") != F.col("idx") - 1, F.lit(True)).alias("starts"),
        F.coalesce(F.col("ahead") != F.col("idx") + 1, F.lit(True)).alias("ends"),
    )
    ends = edges.where("starts or ends").withColumn("chunk_", chunk(length))
    end = F.when(F.col("ends"), F.col("idx"))
    beside = F.min(end).over(Window.partitionBy(*by, "chunk_").orderBy("idx").rowsBetween(0, 1))
    # only the last run of a chunk may end in a later one; that is looked up among the chunks' first ends
    later = Window.partitionBy(*by).orderBy("chunk_").rowsBetween(1, Window.unboundedFollowing)
    onward = ends.groupBy(*by, "chunk_").agg(F.min(end).alias("end_")).withColumn("end_", F.min("end_").over(later))
    paired = ends.withColumn("last", beside).where("starts").join(onward, [*by, "chunk_"])
    return paired.select(*by, F.col("idx").alias("first"), F.coalesce("last", "end_").alias("last"))


def in_runs(samples: DataFrame, runs: DataFrame, by: Sequence[str], length: int = LENGTH) -> DataFrame:
    """samples with the columns of the run (by, first, last, ...) they lie in; runs of a series must not overlap.

    A run leaves one mark in each chunk it touches, and a window carries the latest mark along the chunk's samples, so the work is
    in proportion to samples and marks however many runs a chunk holds.
    """
    told = [c for c in runs.columns if c not in by]
    marks = runs.withColumn("chunk_", F.explode(F.sequence(F.floor(F.col("first") / length), F.floor(F.col("last") / length))))
    marked = marks.select(*by, "chunk_", F.greatest(F.col("first"), F.col("chunk_") * length).alias("idx"), F.lit(0).alias("sample_"), F.struct(*told).alias("run_"))
    placed = samples.withColumns({"chunk_": chunk(length), "sample_": F.lit(1)})
    along = Window.partitionBy(*by, "chunk_").orderBy("idx", "sample_").rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.unionByName(marked, allowMissingColumns=True).withColumn("run_", F.last("run_", ignorenulls=True).over(along))
    return carried.where((F.col("sample_") == 1) & (F.col("idx") <= F.col("run_.last"))).select(*samples.columns, "run_.*")


def in_spans(samples: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """samples with the columns of each span (by, first, last, ...) that holds them; spans may overlap, and are laid out sample by sample."""
    return spans.withColumn("idx", F.explode(F.sequence("first", "last"))).join(samples, [*by, "idx"])
