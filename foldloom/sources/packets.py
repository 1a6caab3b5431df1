"""Packets (arrays of consecutive samples) and samples (one row each), their schemas and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.functions.ids import CODES
from foldloom.sources import tables

PACKET = T.StructType(
    [T.StructField(c, T.StringType()) for c in CODES]
    + [
        T.StructField("starttime", T.TimestampType()),
        T.StructField("sampling_rate", T.DoubleType()),
        T.StructField("npts", T.IntegerType()),
        T.StructField("calib", T.DoubleType()),
        T.StructField("data", T.ArrayType(T.DoubleType())),
        T.StructField("fold", T.ArrayType(T.DoubleType())),
        T.StructField("processing", T.ArrayType(T.StringType())),
    ]
)


def with_fold(packets: DataFrame) -> DataFrame:
    """packets with a fold of one a sample, 0 where masked, unless they carry one."""
    made = F.transform("data", lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(1.0))
    fold = F.coalesce("fold", made) if "fold" in packets.columns else made
    data = F.transform("data", lambda x: F.when(~F.isnan(x), x))
    return packets.withColumns({"fold": fold, "data": data})


def to_samples(packets: DataFrame, *keys: str, start: str = "start") -> DataFrame:
    """One row a sample: keys, idx (start + place), value, fold. A masked sample has fold 0."""
    rows = packets.select(*keys, F.col(start).alias("start_"), F.posexplode(F.arrays_zip("data", "fold")).alias("at_", "x_"))
    value = F.when(~F.isnan("x_.data"), F.col("x_.data"))
    fold = F.when(value.isNull(), 0.0).otherwise(F.coalesce("x_.fold", F.lit(1.0)))
    return rows.select(*keys, (F.col("start_") + F.col("at_")).cast("long").alias("idx"), value.alias("value"), fold.alias("fold"))


def to_packets(samples: DataFrame, size: int, *keys: str) -> DataFrame:
    """Packets of at most `size` samples, cut on the grid; missing samples inside a packet are null with fold 0.

    A packet's list is bounded by size, so no series is gathered whole.
    """
    cut = samples.withColumn("cut_", F.floor(F.col("idx") / size))
    lists = cut.groupBy(*keys, "cut_").agg(F.sort_array(F.collect_list(F.struct("idx", "value", "fold"))).alias("s_"))
    first, last = F.col("s_")[0]["idx"], F.element_at("s_", -1)["idx"]
    by_idx = F.map_from_entries(F.transform("s_", lambda x: F.struct(x["idx"], F.struct(x["value"], x["fold"]))))
    filled = lists.withColumns({"start": first, "last_": last, "m_": by_idx}).withColumn("grid_", F.sequence("start", "last_"))
    data = F.transform("grid_", lambda i: F.try_element_at("m_", i)["value"])
    fold = F.transform("grid_", lambda i: F.coalesce(F.try_element_at("m_", i)["fold"], F.lit(0.0)))
    return filled.select(*keys, "start", F.size("grid_").alias("npts"), data.alias("data"), fold.alias("fold"))


def unmasked(packets: DataFrame, *keys: str) -> DataFrame:
    """The contiguous unmasked pieces of packets (keys, start, data, fold), as packets of their own."""
    at = F.when(F.size("data") > 0, F.sequence(F.lit(0), F.size("data") - 1)).otherwise(F.array().cast("array<int>"))
    live = lambda i: F.get("data", i).isNotNull() & ~F.isnan(F.get("data", i))
    alone = lambda i: ~F.coalesce(live(i), F.lit(False))
    bounds = F.zip_with(F.filter("at_", lambda i: live(i) & alone(i - 1)), F.filter("at_", lambda i: live(i) & alone(i + 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = packets.select(*keys, "start", "data", "fold", at.alias("at_")).withColumn("piece_", F.explode(bounds))
    part = lambda c: F.slice(c, F.col("piece_.a") + 1, F.col("piece_.b") - F.col("piece_.a") + 1).alias(c)
    return pieces.select(*keys, (F.col("start") + F.col("piece_.a")).alias("start"), part("data"), part("fold"))


def invalid(packets: DataFrame) -> DataFrame:
    """Packets that break an invariant: unequal lengths, or a masked sample with a fold."""
    masked: Column = F.exists(F.arrays_zip("data", "fold"), lambda x: x["data"].isNull() & (x["fold"] != 0))
    return packets.where((F.size("data") != F.size("fold")) | masked)


def rejection(codes: tuple[str, ...] = CODES[:4]) -> Column:
    """Why a row can't be a packet: its codes, sampling rate, start, samples or folds lack; null where it can."""
    lacks = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    needed = [c for c in codes if c != "location"]
    reason = F.when(F.greatest(*[lacks(F.col(c)) for c in needed]), "codes")
    reason = reason.when(~F.coalesce(F.col("sampling_rate") > 0, F.lit(False)), "sampling_rate").when(F.col("starttime").isNull(), "starttime")
    return reason.when(F.coalesce(F.size("data") <= 0, F.lit(True)), "data").when(F.coalesce(F.size("fold") != F.size("data"), F.lit(False)), "fold")


def accepted(rows: DataFrame, metric: str | None = None) -> DataFrame:
    """The rows that can be packets. metric: the number of each kind of rejected rows is an observed metric of this name."""
    told = rows.withColumn("reason_", rejection())
    if metric is not None:
        reasons = ("codes", "sampling_rate", "starttime", "data", "fold")
        told = told.observe(metric, *[F.count(F.when(F.col("reason_") == r, 1)).alias(r) for r in reasons])
    return told.where("reason_ is null").drop("reason_")


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    """id, idx, value, fold: each user's hourly means as contributions to the series of the event type."""
    each = tables.event_samples(spark, folder, by_user=True)
    return each.select(F.concat(F.lit("EV.ALL..EV"), "component").alias("id"), "idx", "value", "fold")
