"""Parquet tables as series: events on an hourly grid, line items on a daily one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions.instants import micros

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gridded(rows: DataFrame, keys: dict[str, Column], us: Column, value: Column, step_us: int) -> DataFrame:
    """Samples (keys, idx, value, fold) of raw rows: the mean and the number of the values of each grid cell."""
    named = rows.select(*[c.alias(n) for n, c in keys.items()], F.floor(us / step_us).cast("long").alias("idx"), value.alias("v"))
    return named.where("v is not null").groupBy(*keys, "idx").agg(F.avg("v").alias("value"), F.count("*").cast("double").alias("fold"))


def event_codes(station: Column | None = None) -> dict[str, Column]:
    """Codes of the event series: one instrument a station, whose components are the first letters of the event types."""
    station = F.lit("ALL") if station is None else station
    return {"network": F.lit("EV"), "station": station, "location": F.lit(""), "channel": F.concat(F.lit("EV"), F.upper(F.substring("event_type", 1, 1)))}


def event_samples(spark: SparkSession, folder: str, by_user: bool = False) -> DataFrame:
    """id, instrument, component, idx, value, fold: hourly means of event values, of all users or of each."""
    events = table(spark, folder, "events")
    station = F.concat(F.lit("U"), F.col("user_id")) if by_user else F.lit("ALL")
    instrument = F.concat(F.lit("EV."), station, F.lit("..EV"))
    letter = F.upper(F.substring("event_type", 1, 1))
    return gridded(events, {"id": F.concat(instrument, letter), "instrument": instrument, "component": letter}, micros(F.col("ts")), F.col("value"), HOUR_US)


def item_samples(spark: SparkSession, folder: str) -> DataFrame:
    """id, idx, value, fold: daily mean prices of line items of each return flag and line status."""
    items = table(spark, folder, "lineitem")
    return gridded(items, {"id": F.concat(F.lit("LI."), "l_returnflag", F.lit("."), "l_linestatus")}, micros(F.col("l_shipdate")), F.col("l_extendedprice"), DAY_US)
