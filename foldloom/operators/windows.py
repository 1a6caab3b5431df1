"""Sliding sampling windows of many samples, anchored at the first primary sample of their group.

Every window that meets its conditions is emitted on its own, so a window that is not ready doesn't hold up later ones.
A sample enters only the ceil(length / step) windows that hold it, by arithmetic on its number, and windows are counted by
partial aggregates; no window is compared with samples it can't hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchors(samples: DataFrame, by: Sequence[str], primary: Column) -> DataFrame:
    """The first primary sample number of each group that has a primary sample."""
    return samples.where(primary).groupBy(*by).agg(F.min("idx").alias("anchor"))


def placed(samples: DataFrame, by: Sequence[str], primary: Column, length: int, step: int) -> DataFrame:
    """samples with k, the number of a window that holds them, and anchor; once for each such window."""
    if length < 1 or step < 1:
        raise ValueError("length and step must be at least 1")
    at = F.col("idx") - F.col("anchor")
    low, high = F.greatest(F.floor((at - length) / step) + 1, F.lit(0)), F.floor(at / step)
    joined = samples.join(anchors(samples, by, primary), list(by)).where(F.col("idx") >= F.col("anchor"))
    return joined.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))


def spans(placed: DataFrame, by: Sequence[str], length: int, step: int) -> DataFrame:
    """by, k, first, last of the windows that hold any of the placed samples."""
    first = F.col("anchor") + F.col("k") * step
    return placed.select(*by, "k", first.alias("first"), (first + length - 1).alias("last")).distinct()


def ready(samples: DataFrame, by: Sequence[str], ids: str, primary: Column, length: int, step: int, min_valid: float = 0.9, threshold: float = 1.0, delay: int = 0, eager: bool = False) -> DataFrame:
    """by, k, first, last, valid_fraction of the windows that are ready.

    A primary series must cover min_valid of the window with folds of at least threshold; unless eager, it must also begin at
    the window's first sample or before and end more than `delay` samples after its last.
    """
    if eager and delay:
        raise ValueError("an eager window can't wait")
    spread = placed(samples, by, primary, length, step).where(primary)
    covered = spread.groupBy(*by, ids, "k", "anchor").agg((F.sum(F.when(F.col("fold") >= threshold, 1).otherwise(0)) / F.lit(length)).alias("valid_fraction"))
    first = F.col("anchor") + F.col("k") * step
    windows = covered.where(F.col("valid_fraction") >= min_valid).withColumns({"first": first, "last": first + length - 1})
    if not eager:
        ends = samples.where(primary).groupBy(*by, ids).agg(F.min("idx").alias("start_"), F.max("idx").alias("end_"))
        windows = windows.join(ends, [*by, ids]).where((F.col("start_") <= F.col("first")) & (F.col("end_") - delay > F.col("last"))).drop("start_", "end_")
    return windows.groupBy(*by, "k", "first", "last").agg(F.max("valid_fraction").alias("valid_fraction"))


def owned(samples: DataFrame, by: Sequence[str], primary: Column, length: int, step: int) -> DataFrame:
    """samples with the one window that consumes each: the earliest that holds it; repeated rows stay."""
    if length < 1 or step < 1:
        raise ValueError("length and step must be at least 1")
    at = F.col("idx") - F.col("anchor")
    low, high = F.greatest(F.floor((at - length) / step) + 1, F.lit(0)), F.floor(at / step)
    return samples.join(anchors(samples, by, primary), list(by)).where((at >= 0) & (low <= high)).select(*samples.columns, low.alias("k"))


def model_windows(in_samples: int, sampling_rate: float, overlap: int, count: int = 1) -> dict[str, float]:
    """Seconds of length, step and delay that fit a model's input and stacking depth."""
    if overlap >= in_samples:
        raise ValueError("overlap must be smaller than the window")
    length = in_samples / sampling_rate
    step = (in_samples - overlap) / sampling_rate
    return {"length": length, "step": step, "delay": count * length - (count - 1) * step}


def model_seconds(in_samples: Column, sampling_rate: Column, overlap: Column, count: int = 1) -> dict[str, Column]:
    """The same for columns; null where the overlap is not smaller than the window."""
    fits = lambda c: F.when(overlap < in_samples, c)
    length, step = in_samples / sampling_rate, (in_samples - overlap) / sampling_rate
    return {"length": fits(length), "step": fits(step), "delay": fits(count * length - (count - 1) * step)}


def padded(samples: DataFrame, by: Sequence[str], windows: DataFrame, length: int) -> DataFrame:
    """Every sample number of every window and id; missing samples are masked with fold 0."""
    ids = [c for c in samples.columns if c not in ("idx", "value", "fold")]
    grid = windows.join(samples.select(*ids).distinct(), list(by)).select(*ids, "k", F.explode(F.sequence("first", F.col("first") + length - 1)).alias("idx"))
    return grid.join(samples, [*ids, "idx"], "left").withColumn("fold", F.coalesce("fold", F.lit(0.0)))
