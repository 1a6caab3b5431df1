"""Live queries: the stored events as a stream in several batches, with heartbeats behind them, through stateful operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.operators import predict, trigger
from foldloom.plans import detection_queries as detection
from foldloom.plans import signal_queries  # noqa: F401  (its SQL)
from foldloom.plans.catalog import ORACLES, query
from foldloom.plans.series_queries import GRID
from foldloom.sources import scratch, tables
from foldloom.streaming import live, processors

HOUR = tables.HOUR_US
#: samples that may still change, samples of silence after which a series ends, and how late an event may come
MUTE, TIMEOUT, LATENESS = 4, 240, "6 hours"
PARTITIONS = "spark.sql.shuffle.partitions"


def in_parts(rows: DataFrame, part: Column, backwards: bool = False) -> str:
    """rows as a folder of files, one a part, whose times of change rise (or fall) with the part; returns its path pattern.

    The number of parts is that of batches; their list passes through the driver.
    """
    spark = rows.sparkSession
    path = scratch.new_folder(spark, "parts")
    rows.withColumn("part", part.cast("int")).repartition("part").write.partitionBy("part").parquet(path)
    where, files = scratch.place(spark, path)
    parts = sorted((int(s.getPath().getName().partition("=")[2]), s.getPath()) for s in files.listStatus(where) if s.isDirectory())
    for k, (_, folder) in enumerate(reversed(parts) if backwards else parts):
        for file in files.listStatus(folder):
            files.setTimes(file.getPath(), 1_600_000_000_000 + 60_000 * k, -1)
    return f"{path}/*"


def events_live(spark: SparkSession, folder: str, backwards: bool = False, late: bool = True) -> DataFrame:
    """Events in parts of five days as a stream, one part a batch. late: some events come with the part after their own.

    Two heartbeats follow, rows of no series, each of which moves the event time on so far that all series before it are silent.
    """
    events = tables.table(spark, folder, "events").where("value is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.upper(F.substring("event_type", 1, 1)).alias("component"), "value")
    hour = F.floor(F.unix_micros("ts") / HOUR)
    last = events.agg(F.max("ts").alias("ts"))
    beats = last.select(F.lit(None).cast("long").alias("event_id"), F.explode(F.array(*[F.col("ts") + F.expr(f"interval {n} hours") for n in (400, 800)])).alias("ts"), F.lit("").alias("component"), F.lit(None).cast("double").alias("value"))
    behind = F.coalesce(F.col("event_id") % 4, F.lit(0)) if late else F.lit(0)
    path = in_parts(events if backwards else events.unionByName(beats), F.floor((hour + behind) / 120), backwards)
    schema = events.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", LATENESS)


def samples_live(stream: DataFrame) -> DataFrame:
    """id, instrument, component, idx, value, fold, ts of each event on the hourly grid."""
    instrument = F.when(F.col("component") == "", "").otherwise("EV.ALL..EV")
    return stream.select(F.concat(instrument, "component").alias("id"), instrument.alias("instrument"), "component", F.floor(F.unix_micros("ts") / HOUR).cast("long").alias("idx"), "value", F.lit(1.0).alias("fold"), "ts")


def state_partitions(spark: SparkSession, folder: str, name: str = "events") -> int:
    """Partitions of keyed state for a stream of a stored table: one for each advisory partition size of its files, at most the session's shuffle partitions.

    A streaming query keeps its number from the first batch on, and adaptive execution joins none of its partitions, however small: each of them costs a
    Python worker's task and a commit of its state store in every batch.
    """
    where, files = scratch.place(spark, f"{folder}/{name}.parquet")
    advised = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    return max(1, min(int(spark.conf.get(PARTITIONS)), math.ceil(files.getContentSummary(where).getLength() / advised)))


def collected(stream: DataFrame, mode: str = "append", fail_at: int | None = None, partitions: int | None = None) -> DataFrame:
    """Run a stream over all that is there, and read what its batches wrote, with the number of the batch (update mode); each batch has a folder of its own, so
    writing it again replaces it.

    fail_at: the query breaks down after writing that batch, before it is done, and is started again from its checkpoint.
    partitions: those of its keyed state, else the session's shuffle partitions.
    """
    spark = stream.sparkSession
    root = scratch.new_folder(spark, "stream")

    def write(batch: DataFrame, number: int, broken: list[int] = []) -> None:  # noqa: B006
        (batch.withColumn("batch", F.lit(number)) if mode == "update" else batch).write.mode("overwrite").parquet(f"{root}/out/{number}")
        if number == fail_at and not broken:
            broken.append(number)
            raise RuntimeError("broken down")

    def start() -> None:
        usual = spark.conf.get(PARTITIONS)
        spark.conf.set(PARTITIONS, partitions or usual)
        try:  # a query takes a copy of the session's settings as it starts
            run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start()
        finally:
            spark.conf.set(PARTITIONS, usual)
        run.awaitTermination()

    try:
        start()
    except StreamingQueryException:
        if fail_at is None:
            raise
        start()
    schema = T.StructType([*stream.schema.fields, *([T.StructField("batch", T.IntegerType())] if mode == "update" else [])])
    return spark.read.schema(schema).parquet(f"{root}/out/*")


def with_provider(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """f with the state store that keyed state needs."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set(*processors.PROVIDER)
        return f(spark, folder)

    return run


@query("stream_triggers", ORACLES["trigger_summary"])
@with_provider
def stream_triggers(spark: SparkSession, folder: str) -> DataFrame:
    """Triggers of the live series: those of the whole series, however the events come in batches."""
    found = live.triggers(samples_live(events_live(spark, folder)), detection.ON, detection.OFF, HOUR, MUTE, TIMEOUT)
    return detection._rounded(collected(found))


@query("stream_triggers_restarted", ORACLES["trigger_fold_gate"])
@with_provider
def stream_triggers_restarted(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the fold gate, broken down in the third batch and started again: each trigger leaves once."""
    found = live.triggers(samples_live(events_live(spark, folder)), detection.ON, detection.OFF, HOUR, MUTE, TIMEOUT)
    return detection._rounded(collected(found, fail_at=2).where("low >= 2"))


def picked(windows: DataFrame, length: int, blinding: int, thr_on: float, thr_off: float) -> DataFrame:
    """A stream of repaired windows as a stream of picks: scores, blinded edges, and the triggers of the label series, a second stateful operator."""
    scorer = predict.scores(predict.energy_ratio(max(1, length // 12), max(2, length // 3)))
    scored = windows.withColumn("scores", scorer("tensor"))
    pair = F.arrays_zip("fold", F.col("scores")[1].alias("P"), F.col("scores")[2].alias("S"))
    each = scored.select("instrument", "first", "known", F.posexplode(pair).alias("at", "x")).where((F.col("at") >= blinding) & (F.col("at") < length - blinding) & (F.col("x.fold") > 0))
    labels = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"x.{c}").alias("value")) for c in ("P", "S")]))
    series = each.select("instrument", "known", (F.col("first") + F.col("at")).alias("idx"), F.col("x.fold").alias("fold"), labels.alias("y"))
    samples = series.select(F.concat("instrument", "y.label", F.lit(".ER.fast")).alias("id"), "idx", "y.value", "fold", "known")
    return trigger.picks(live.triggers(samples, thr_on, thr_off, HOUR, length, TIMEOUT + length), thr_on, HOUR)


@query("stream_picking", ORACLES["picking_pipeline"])
@with_provider
def stream_picking(spark: SparkSession, folder: str) -> DataFrame:
    """From events to picks in one streaming query of two chained stateful operators; its rows are those of picking_pipeline."""
    samples = samples_live(events_live(spark, folder))
    windows = live.instrument_windows(samples, "PCS", 24, 12, HOUR, MUTE, TIMEOUT, primary_share=0.9)
    found = collected(picked(windows, 24, 2, 0.5, 0.3), partitions=state_partitions(spark, folder))
    rounded = {c: F.round(c, n) for c, n in (("p_max", 6), ("fold_mean", 6), ("confidence", 4))}
    return found.select("id", "on", "off", "npts", "at_max", "pick_us", "lower", "upper", "quality", *[v.alias(c) for c, v in rounded.items()])


#: the event series on a grid of ten minutes, each piece between gaps of over 12 samples a series s of its own
PIECES = f"""{GRID.replace("with g", "with recursive g").replace("3600000000", "600000000")}, j as (select *, case when idx - lag(idx) over (partition by id order by idx) > 12 then 1 else 0 end as cut from g),
p as (select id, id || '#' || sum(cut) over (partition by id order by idx) as s, idx, value, fold from j), z as (select s, any_value(id) as id, min(idx) as a, max(idx) as e from p group by s)"""


def _windows_sent(consume: bool) -> str:
    """Windows in SQL. w: after each move, the start f of the next window, the newest sample `now`, the last sample c that counts no more, and the window sent.

    A window waits for the sample that ends its delay of two; if it is not ready then, it holds up the next ones until the buffer of 240 samples has moved past
    it. What is left when a series ends leaves at once: windows from f on (l), as far as they have enough samples that count.
    """
    counts = lambda a, s="x.s": f"(select count(*) from p where p.s = {s} and p.idx > x.c and p.idx between {a} and {a} + 23 and p.fold >= 1) / 24::double"
    fresh = lambda low: f"(select min(idx) from p where p.s = x.s and p.idx >= {low} and p.idx > x.c)"
    gone = "f + 23" if consume else "c"
    ended = "greatest(c, first - 12 + 23)" if consume else "c"
    return f"""{PIECES}, w as (select s, a as f, a as now, -1::bigint as c, null::bigint as sent from z union all
select x.s, case when f < e1 - 239 then {fresh("e1 - 239")} when vf >= 0.2 then f + 12 else {fresh("e2 - 239")} end, case when f < e1 - 239 or vf >= 0.2 then e1 else e2 end,
case when f >= e1 - 239 and vf >= 0.2 then {gone} else c end, case when f >= e1 - 239 and vf >= 0.2 then f end
from (select x.*, (select min(idx) from p where p.s = x.s and p.idx >= greatest(x.f + 26, x.now)) as e1, (select min(idx) from p where p.s = x.s and p.idx >= x.f + 240) as e2, {counts("x.f")} as vf from w x where x.f is not null) x where e1 is not null),
y as (select s, max(now) as now from w group by s), b as (select w.s, max_by(w.f, (w.now, w.f)) as f, max(w.c) as c from w where f is not null group by w.s),
l as (select x.s, x.c, z.e, case when x.f >= z.e - 239 then x.f else {fresh("z.e - 239")} end as f from b x join z on z.s = x.s),
r(s, c, e, first, sent) as (select s, c, e, f, null::bigint from l where f is not null union all
select x.s, case when {counts("x.first")} >= 0.2 then {"x.first + 23" if consume else "x.c"} else x.c end, x.e, x.first + 12, case when {counts("x.first")} >= 0.2 then x.first end from r x where x.first <= x.e),
m as (select s, sent from w where sent is not null union all select s, sent from r where sent is not null),
o as (select m.s, m.sent as first, unnest(range(m.sent, m.sent + 24)) as idx from m)
select z.id, o.first, o.idx, round(p.value, 6) as value, coalesce({"case when o.idx > coalesce(k.c, -1) then p.fold end" if consume else "p.fold"}, 0) as fold from o join z on z.s = o.s left join p on p.s = o.s and p.idx = o.idx
{"left join (select s, sent, lag(sent) over (partition by s order by sent) + 23 as c from m) k on k.s = o.s and k.sent = o.first" if consume else ""}"""


TEN_MINUTES = 600_000_000


def _windows(spark: SparkSession, folder: str, consume: bool, fail_at: int | None = None) -> DataFrame:
    rows = events_live(spark, folder, late=False)
    series = F.when(F.col("component") == "", "").otherwise(F.concat(F.lit("EV.ALL..EV"), "component"))
    packets = rows.select(series.alias("id"), F.floor(F.unix_micros("ts") / TEN_MINUTES).cast("long").alias("start"), F.array("value").alias("data"), F.array(F.lit(1.0)).alias("fold"), "ts")
    made = collected(processors.windowed(packets, 240, 24, 12, min_valid=0.2, delay=2, consume=consume, timeout=12, step_us=TEN_MINUTES), fail_at=fail_at)
    each = made.select("id", "first", F.posexplode(F.arrays_zip("value", "fold")).alias("at", "x"))
    return each.select("id", "first", (F.col("first") + F.col("at")).alias("idx"), F.round("x.value", 6).alias("value"), "x.fold")


@query("stream_windows_expired", _windows_sent(False))
@with_provider
def stream_windows_expired(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of four hours every two hours; a series silent for two hours ends, and its last windows leave then."""
    return _windows(spark, folder, False)


@query("stream_windows_consumed", _windows_sent(True))
@with_provider
def stream_windows_consumed(spark: SparkSession, folder: str) -> DataFrame:
    """The same, each sample counted in one window only, by a query that breaks down half-way and goes on from its checkpoint."""
    return _windows(spark, folder, True, fail_at=3)


def _buffers(spark: SparkSession, folder: str, length: int, backwards: bool, **how: str) -> DataFrame:
    """The last state of every ring buffer, sample by sample."""
    rows = samples_live(events_live(spark, folder, backwards, late=False)).where("component <> ''")
    packets = rows.select("id", F.col("idx").alias("start"), F.array("value").alias("data"), F.array("fold").alias("fold"))
    states = collected(processors.buffered(packets, length, **how), "update", partitions=state_partitions(spark, folder))
    last = states.groupBy("id").agg(F.max_by(F.struct("start", "value", "fold"), "batch").alias("s")).select("id", "s.start", F.posexplode(F.arrays_zip("s.value", "s.fold")).alias("at", "x"))
    return last.select("id", (F.col("start") + F.col("at")).alias("idx"), F.round("x.value", 6).alias("value"), "x.fold")


@query(
    "stream_buffer_backwards",
    f"""{GRID}, d as (select g.* from g, (select min(idx) // 120 as part from g) where idx // 120 = part), e as (select id, max(idx) as e from d group by id), r as (select id, e, unnest(range(e - 99, e + 1)) as idx from e)
select r.id, r.idx, round(d.value, 6) as value, coalesce(d.fold, 0) as fold from r left join d on d.id = r.id and d.idx = r.idx""",
)
@with_provider
def stream_buffer_backwards(spark: SparkSession, folder: str) -> DataFrame:
    """Ring buffers that may move back, fed with the newest part of the series first: in the end they hold the oldest part."""
    return _buffers(spark, folder, 100, True, past="unrestricted")


@query(
    "stream_buffer_edge",
    f"""{GRID}, e as (select id, min(idx) as a from g group by id), r as (select id, unnest(range(a, a + 1500)) as idx from e)
select r.id, r.idx, round(g.value, 6) as value, coalesce(g.fold, 0) as fold from r left join g on g.id = r.id and g.idx = r.idx""",
)
@with_provider
def stream_buffer_edge(spark: SparkSession, folder: str) -> DataFrame:
    """Ring buffers that take their first packet by its start: with room for all, they begin where the series does."""
    return _buffers(spark, folder, 1500, False, edge="start")
