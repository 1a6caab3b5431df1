"""Wave messages and pick messages: validation, conversion from and to packets, message codes, and fixed-width text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.functions import shapes
from foldloom.functions.instants import MICROS, instant, micros

WAVE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("station", "network", "channel", "location")]
    + [
        T.StructField("nsamp", T.IntegerType()),
        T.StructField("samprate", T.DoubleType()),
        T.StructField("startt", T.DoubleType()),
        T.StructField("endt", T.DoubleType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ]
)
#: fixed values: data types of wave messages, the number type each stands for, and the range of the integer ones
DATATYPES = {"i2": ("smallint", 2**15 - 1), "i4": ("int", 2**31 - 1), "i8": ("bigint", 2**63 - 1), "f4": ("float", None)}
#: fixed values: message names and codes
MESSAGE_CODES = {
    "TYPE_WILDCARD": 0,
    "TYPE_ADBUF": 1,
    "TYPE_ERROR": 2,
    "TYPE_HEARTBEAT": 3,
    "TYPE_TRACE2_COMP_UA": 4,
    "TYPE_NANOBUF": 5,
    "TYPE_ACK": 6,
    "TYPE_PICK_SCNL": 8,
    "TYPE_CODA_SCNL": 9,
    "TYPE_PICK2K": 10,
    "TYPE_CODA2K": 11,
    "TYPE_PICK2": 12,
    "TYPE_CODA2": 13,
    "TYPE_HYP2000ARC": 14,
    "TYPE_H71SUM2K": 15,
    "TYPE_HINBARC": 17,
    "TYPE_H71SUM": 18,
    "TYPE_TRACEBUF2": 19,
    "TYPE_TRACEBUF": 20,
    "TYPE_LPTRIG": 21,
    "TYPE_CUBIC": 22,
    "TYPE_CARLSTATRIG": 23,
    "TYPE_TRIGLIST": 24,
    "TYPE_TRIGLIST2K": 25,
    "TYPE_TRACE_COMP_UA": 26,
    "TYPE_STRONGMOTION": 27,
    "TYPE_MAGNITUDE": 28,
    "TYPE_STRONGMOTIONII": 29,
    "TYPE_LOC_GLOBAL": 30,
    "TYPE_LPTRIG_SCNL": 31,
    "TYPE_CARLSTATRIG_SCNL": 32,
    "TYPE_TRIGLIST_SCNL": 33,
    "TYPE_TD_AMP": 34,
    "TYPE_MSEED": 35,
    "TYPE_NOMAGNITUDE": 36,
    "TYPE_NAMED_EVENT": 94,
    "TYPE_HYPOTWC": 95,
    "TYPE_PICK_GLOBAL": 96,
    "TYPE_PICKTWC": 97,
    "TYPE_ALARM": 98,
}
#: fixed value: amplitudes of picks are written up to this
MOST_AMPLITUDE = 99_999_999


def is_empty(name: str = "station") -> Column:
    """Whether a row stands for the absence of a message."""
    return F.coalesce(F.length(F.trim(F.col(name))) == 0, F.lit(True)) & F.coalesce(F.size("data") <= 0, F.lit(True))


def is_wave() -> Column:
    """Whether a row is a complete and consistent wave message."""
    ends = F.abs(F.col("endt") - (F.col("startt") + (F.col("nsamp") - 1) / F.col("samprate")))
    known = F.col("datatype").isin(*DATATYPES)
    sized = (F.size("data") == F.col("nsamp")) & (F.col("nsamp") > 0) & (F.col("samprate") > 0)
    return F.coalesce(sized & known & (ends * F.col("samprate") < 0.5), F.lit(False))


def wave_to_packet(waves: DataFrame) -> DataFrame:
    """Packets of valid wave messages; folds are one."""
    return waves.where(is_wave()).select(
        "network",
        "station",
        "location",
        "channel",
        F.lit("").alias("model"),
        F.lit("").alias("weight"),
        instant(F.rint(F.col("startt") * MICROS)).alias("starttime"),
        F.col("samprate").alias("sampling_rate"),
        F.col("nsamp").alias("npts"),
        F.lit(1.0).alias("calib"),
        "data",
        F.transform("data", lambda _: F.lit(1.0)).alias("fold"),
        F.array().cast("array<string>").alias("processing"),
    )


def packet_to_wave(packets: DataFrame, datatype: str = "f4") -> DataFrame:
    """Wave messages of packets, one for each stretch without masks; starts are rounded to 10 ms, integers are cut to range.

    Each packet is a bounded array, so its stretches are found within the row.
    """
    if datatype not in DATATYPES:
        raise ValueError(f"datatype must be one of {', '.join(DATATYPES)}")
    _, most = DATATYPES[datatype]
    live = lambda i: F.get("data", i).isNotNull() & (F.get("fold", i) > 0)
    places = F.sequence(F.lit(0), F.size("data") - 1)
    begins = F.filter(places, lambda i: live(i) & ((i == 0) | ~F.coalesce(live(i - 1), F.lit(False))))
    ends = F.filter(places, lambda i: live(i) & ~F.coalesce(live(i + 1), F.lit(False)))
    cut = packets.where(F.size("data") > 0).withColumn("run_", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))))
    us = micros(F.col("starttime")) + F.rint(F.col("run_.a") * MICROS / F.col("sampling_rate")).cast("long")
    start = F.rint(us / 10_000) / 100
    n = F.col("run_.b") - F.col("run_.a") + 1
    kept = F.slice("data", F.col("run_.a") + 1, n)
    data = kept if most is None else F.transform(kept, lambda x: F.greatest(F.least(F.rint(x), F.lit(float(most))), F.lit(-float(most))))
    named = cut.select("station", "network", "channel", "location", n.cast("int").alias("nsamp"), F.col("sampling_rate").alias("samprate"), start.alias("startt"), data.alias("data"))
    return named.select(
        "station", "network", "channel", "location", "nsamp", "samprate", "startt", (F.col("startt") + (F.col("nsamp") - 1) / F.col("samprate")).alias("endt"), F.lit(datatype).alias("datatype"), "data"
    )


def message_codes(spark: SparkSession) -> DataFrame:
    """name and code of each kind of message; a table of fixed size."""
    return spark.createDataFrame(list(MESSAGE_CODES.items()), "name string, code int")


def with_code(rows: DataFrame, name: str = "name") -> DataFrame:
    """rows with the code of their message kind, null for unknown ones. The lookup table is a constant of this module."""
    return rows.join(F.broadcast(message_codes(rows.sparkSession)), name, "left")


def stamp(us: Column) -> Column:
    """yyyyMMddHHmmss.ff with zero-padded seconds and hundredths; rounded to the hundredth."""
    rounded = F.rint(us / 10_000).cast("long") * 10_000
    return F.concat(F.date_format(instant(rounded), "yyyyMMddHHmmss"), F.lit("."), F.lpad((F.pmod(rounded, F.lit(MICROS)) / 10_000).cast("int").cast("string"), 2, "0"))


def pick2k(rows: DataFrame) -> DataFrame:
    """rows with a fixed-width PICK2K line.

    Needs modid, orgid, seq (int); station, component, network, polarity, phase (string); quality (int); pick_us (long);
    amp1, amp2, amp3 (double). Codes are cut to their width, amplitudes to MOST_AMPLITUDE.
    """
    amp = lambda c: F.least(F.coalesce(F.rint(c), F.lit(0.0)), F.lit(float(MOST_AMPLITUDE))).cast("long")
    fixed = lambda c, n: F.rpad(F.coalesce(F.substring(c, 1, n), F.lit("")), n, " ")
    head = F.format_string("%3d%3d%3d%5d", F.lit(MESSAGE_CODES["TYPE_PICK2K"]), F.col("modid"), F.col("orgid"), F.col("seq") % 10_000)
    codes = F.concat(fixed("station", 5), fixed("network", 2), fixed("component", 3))
    mark = F.concat(F.lit(" "), fixed("polarity", 1), F.col("quality").cast("string"), fixed("phase", 2))
    amps = F.format_string("%08d%08d%08d", amp("amp1"), amp("amp2"), amp("amp3"))
    return rows.withColumn("message", F.concat(head, F.lit(" "), codes, mark, stamp(F.col("pick_us")), amps, F.lit("\n")))


def graded_pick2k(rows: DataFrame, uncertainty: str = "uncertainty") -> DataFrame:
    """pick2k of rows whose quality is the grade of their uncertainty in seconds; rows without one are of the last grade."""
    return pick2k(rows.withColumn("quality", shapes.grade(F.coalesce(F.col(uncertainty), F.lit(float("inf"))))))


def pick_scnl(rows: DataFrame) -> DataFrame:
    """rows with a space-separated PICK_SCNL line, its time in milliseconds; an empty location is --.

    Needs modid, orgid, seq, station, channel, network, location, polarity (U, D or ?), quality (0 to 4), pick_us, phase, amp1 to amp3.
    """
    location = F.when(F.coalesce(F.length("location"), F.lit(0)) == 0, "--").otherwise(F.col("location"))
    scnl = F.concat_ws(".", "station", "channel", "network", location)
    amps = F.concat_ws(" ", *[F.rint(c).cast("long").cast("string") for c in ("amp1", "amp2", "amp3")])
    head = F.concat_ws(" ", F.lit(str(MESSAGE_CODES["TYPE_PICK_SCNL"])), *[F.col(c).cast("string") for c in ("modid", "orgid", "seq")])
    mark = F.concat(F.when(F.col("polarity").isin("U", "D"), F.col("polarity")).otherwise("?"), F.least(F.greatest("quality", F.lit(0)), F.lit(4)).cast("string"))
    time = F.date_format(instant(F.floor(F.col("pick_us") / 1000) * 1000), "yyyy-MM-dd HH:mm:ss.SSS")
    return rows.withColumn("message", F.concat(F.concat_ws(" ", head, scnl, mark, time, "phase", amps), F.lit("\n")))
