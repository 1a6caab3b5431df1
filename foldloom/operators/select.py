"""Selection of series by their identity and header, as boolean columns that reach the scan.

Criteria on id keys are shell patterns; criteria on numbers are equalities. They combine by intersection, union or
symmetric difference, and may be inverted; without criteria everything is chosen.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import ids
from foldloom.sources.scratch import stored

NUMBERS = ("sampling_rate", "npts", "delta", "calib")
COMBINE = {"intersection": operator.and_, "union": operator.or_, "symmetric": lambda a, b: a != b}


def criterion(name: str, wanted: object) -> Column:
    if name in NUMBERS:
        return F.coalesce(F.col(name).cast("double") == F.lit(float(wanted)), F.lit(False))
    key = ids.id_key(name)
    if isinstance(wanted, list | tuple | set | frozenset):
        return reduce(operator.or_, [ids.matches(key, w) for w in wanted]) if wanted else F.lit(False)
    return ids.matches(key, wanted)


def chosen(how: str = "intersection", inverse: bool = False, **criteria: object) -> Column:
    """The condition of a selection."""
    if how not in COMBINE:
        raise ValueError(f"how must be one of {', '.join(COMBINE)}")
    all_of = reduce(COMBINE[how], [criterion(k, v) for k, v in criteria.items()]) if criteria else F.lit(True)
    return ~all_of if inverse else all_of


def select(df: DataFrame, how: str = "intersection", inverse: bool = False, **criteria: object) -> DataFrame:
    return df.where(chosen(how, inverse, **criteria))


def lookup(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows whose key is one of the values."""
    return df.where(ids.id_key(key).isin(list(values)))


def positions(df: DataFrame, order: Sequence[str], first: int = 0, last: int | None = None, step: int = 1) -> DataFrame:
    """Rows first to last - 1 by `step` in the given order, counted from 0.

    With a last one, only so many rows are ordered (a distributed top list). Without, rows are dealt by ranges of the order into the
    shared folder, numbered within each range, and moved on by the numbers of rows of the ranges before.
    """
    if last is not None:
        placed = df.orderBy(*order).limit(last).withColumn("place_", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        dealt = stored(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
        sizes = dealt.groupBy("range_").agg(F.count("*").alias("size_"))
        before = sizes.select("range_", F.coalesce(F.sum("size_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
        own = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
        placed = dealt.withColumn("own_", own).join(F.broadcast(before), "range_").withColumn("place_", F.col("own_") + F.col("before_")).drop("range_", "own_", "before_")
    return placed.where((F.col("place_") >= first) & ((F.col("place_") - first) % step == 0)).drop("place_")


def split_on(df: DataFrame, key: str) -> DataFrame:
    """df with its part named in a column `part`, hashed by it, for work part by part."""
    return df.withColumn("part", ids.id_key(key)).repartition("part")


def view(samples: DataFrame, start_us: int | None, end_us: int | None, origin_us: int, sampling_rate: float) -> DataFrame:
    """Samples from the nearest to start to the nearest to end, both included; an interval before the series is empty."""
    nearest = lambda us: round((us - origin_us) * sampling_rate / 1_000_000)  # noqa: E731  Python rounds halves to even
    if start_us is not None and end_us is not None and start_us > end_us:
        raise ValueError("the view starts after its end")
    low = F.lit(True) if start_us is None else F.col("idx") >= nearest(start_us)
    return samples.where(low if end_us is None else low & (F.col("idx") <= nearest(end_us)))


def replaced(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """df with the rows of `new` in place of those of the same key."""
    return df.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def common_id(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The codes that all rows of a group share, * where they differ."""
    shared = [F.when(F.count_distinct(F.coalesce(c, F.lit(""))) == 1, F.max(F.coalesce(c, F.lit("")))).otherwise("*").alias(c) for c in ids.CODES]
    return df.groupBy(*by).agg(*shared)


def unmergeable(packets: DataFrame) -> DataFrame:
    """Ids whose packets differ in sampling rate or calibration, and so must not be merged."""
    kinds = packets.groupBy("id").agg(F.count_distinct("sampling_rate").alias("rates"), F.count_distinct("calib").alias("calibs"))
    return kinds.where("rates > 1 or calibs > 1")


def equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def in_inventory(df: DataFrame, inventory: DataFrame, *keys: str, inverse: bool = False) -> DataFrame:
    """Rows whose key values stand in an inventory table, or those that don't; keys are columns of both."""
    return df.join(inventory.select(*keys).distinct(), list(keys), "left_anti" if inverse else "left_semi")


def id_set(left: DataFrame, right: DataFrame, how: str, key: str = "id") -> DataFrame:
    """Distinct keys of two tables: union, intersection or difference."""
    a, b = left.select(key), right.select(key)
    made = {"union": lambda: a.union(b).distinct(), "intersection": lambda: a.intersect(b), "difference": lambda: a.subtract(b)}
    if how not in made:
        raise ValueError(f"how must be one of {', '.join(made)}")
    return made[how]()
