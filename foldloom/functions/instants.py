"""Instants and sample numbers. All times are UTC, in microseconds since 1970 where they are numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

#: fixed values: the days on which TAI - UTC grew by a second, as (UTC day, TAI - UTC from then on); IERS Bulletin C
LEAP_DAYS = (
    ("1972-01-01", 10),
    ("1972-07-01", 11),
    ("1973-01-01", 12),
    ("1974-01-01", 13),
    ("1975-01-01", 14),
    ("1976-01-01", 15),
    ("1977-01-01", 16),
    ("1978-01-01", 17),
    ("1979-01-01", 18),
    ("1980-01-01", 19),
    ("1981-07-01", 20),
    ("1982-07-01", 21),
    ("1983-07-01", 22),
    ("1985-07-01", 23),
    ("1988-01-01", 24),
    ("1990-01-01", 25),
    ("1991-01-01", 26),
    ("1992-07-01", 27),
    ("1993-07-01", 28),
    ("1994-07-01", 29),
    ("1996-01-01", 30),
    ("1997-07-01", 31),
    ("1999-01-01", 32),
    ("2006-01-01", 33),
    ("2009-01-01", 34),
    ("2012-07-01", 35),
    ("2015-07-01", 36),
    ("2017-01-01", 37),
)


def micros(instant: Column) -> Column:
    """Microseconds of a timestamp of either kind."""
    return F.unix_micros(instant.cast("timestamp"))


def instant(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long"))


def nearest_index(us: Column, start_us: Column, sampling_rate: Column) -> Column:
    """The number of the sample nearest to an instant; halves go to the even one."""
    return F.rint((us - start_us) * sampling_rate / MICROS).cast("long")


def index_micros(idx: Column, start_us: Column, sampling_rate: Column) -> Column:
    return start_us + F.rint(idx * MICROS / sampling_rate).cast("long")


def leap_seconds(us: Column) -> Column:
    """Leap seconds between 1972 and an instant: TAI - UTC less the ten of 1972."""
    steps = F.lit(0)
    for day, offset in LEAP_DAYS:
        steps = F.when(us >= F.unix_micros(F.lit(f"{day} 00:00:00+00:00").cast("timestamp")), offset - 10).otherwise(steps)
    return steps


def leap_corrected_epoch(us: Column) -> Column:
    """Seconds since 1970 less the leap seconds since 1972."""
    return us / MICROS - leap_seconds(us)


def pick_micros(pick: Column, low: Column, high: Column) -> Column:
    """The time of a pick: itself, or else the middle of its interval, or the end that is there."""
    return F.coalesce(pick, F.floor((low + high) / 2), low, high)
