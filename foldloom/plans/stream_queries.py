"""Streaming queries, run over the stored tables until all rows are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.plans.catalog import query
from foldloom.plans.series_queries import GRID
from foldloom.sources import scratch, tables
from foldloom.streaming import processors


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """events as a stream, its time as a timestamp (watermarks need one)."""
    schema = tables.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there; the rows of its last (complete, update) or of all batches (append)."""
    spark = stream.sparkSession
    root = scratch.new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/{'all' if mode == 'complete' else number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    path = f"{root}/out/all" if mode == "complete" else f"{root}/out/*"
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "stream_grid",
    """select 'EV.ALL..EV' || upper(substr(event_type, 1, 1)) as id, epoch_us(ts) // 3600000000 as idx, round(avg(value), 6) as value, count(value) as fold from events where value is not null group by all""",
)
def stream_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly grid as a watermarked streaming aggregate."""
    rows = event_stream(spark, folder).where("value is not null")
    cells = processors.gridded(rows, "ts", F.col("value"), {"id": F.concat(F.lit("EV.ALL..EV"), F.upper(F.substring("event_type", 1, 1)))}, "1 hour", "1 day")
    done = finished(cells, "complete")
    return done.select("id", (F.unix_micros("cell.start") / tables.HOUR_US).cast("long").alias("idx"), F.round("value", 6).alias("value"), "fold")


def packet_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a packet of one sample on the hourly grid."""
    rows = event_stream(spark, folder).where("value is not null")
    idx = F.floor(F.unix_micros("ts") / tables.HOUR_US).cast("long")
    return rows.select(F.concat(F.lit("EV.ALL..EV"), F.upper(F.substring("event_type", 1, 1))).alias("id"), idx.alias("start"), F.array("value").alias("data"), F.array(F.lit(1.0)).alias("fold"))


@query(
    "stream_buffer",
    f"""{GRID}, b as (select *, case when idx - 167 > lag(idx) over (partition by id order by idx) then 1 else 0 end as reset from g), e as (select id, max(idx) as e, sum(reset)::bigint as resets from b group by id),
w as (select id, resets, unnest(range(e - 167, e + 1)) as idx from e) select w.id, w.idx, round(g.value, 6) as value, coalesce(g.fold, 0) as fold, 0::bigint as late, w.resets from w left join g on g.id = w.id and g.idx = w.idx""",
)
def stream_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """The last week of each series as a ring buffer holds it, sample by sample."""
    spark.conf.set(*processors.PROVIDER)
    held = finished(processors.buffered(packet_stream(spark, folder), 168), "update")
    each = held.select("id", "start", "late", "resets", F.posexplode(F.arrays_zip("value", "fold")).alias("at", "x"))
    return each.select("id", (F.col("start") + F.col("at")).alias("idx"), F.round("x.value", 6).alias("value"), "x.fold", "late", "resets")


#: w: the start f of the next window and the newest sample `now` after each move, and the window sent in it. A window that is not ready
#: holds up the next ones until the buffer of 240 samples has moved past its start; the series is then anchored anew.
SENT = f"""{GRID.replace("with g", "with recursive g")}, w as (select id, min(idx) as f, min(idx) as now, null::bigint as sent from g group by id union all
select x.id, case when f < e1 - 239 then (select min(idx) from g where g.id = x.id and g.idx >= e1 - 239) when vf >= 0.2 then f + 12 else (select min(idx) from g where g.id = x.id and g.idx >= e2 - 239) end,
case when f < e1 - 239 or vf >= 0.2 then e1 else e2 end, case when f >= e1 - 239 and vf >= 0.2 then f end
from (select w.id, w.f, (select min(idx) from g where g.id = w.id and g.idx >= greatest(w.f + 26, w.now)) as e1, (select min(idx) from g where g.id = w.id and g.idx >= w.f + 240) as e2,
(select count(*) from g where g.id = w.id and g.idx between w.f and w.f + 23 and g.fold >= 1) / 24::double as vf from w where w.f is not null) x where e1 is not null)"""


@query(
    "stream_windows",
    f"""{SENT}, p as (select id, sent as first, unnest(range(sent, sent + 24)) as idx from w where sent is not null)
select p.id, p.first, p.idx, round(g.value, 6) as value, coalesce(g.fold, 0) as fold from p left join g on g.id = p.id and g.idx = p.idx""",
)
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of a day every half day, two hours late, sample by sample."""
    spark.conf.set(*processors.PROVIDER)
    made = finished(processors.windowed(packet_stream(spark, folder), 240, 24, 12, min_valid=0.2, delay=2), "append")
    each = made.select("id", "first", F.posexplode(F.arrays_zip("value", "fold")).alias("at", "x"))
    return each.select("id", "first", (F.col("first") + F.col("at")).alias("idx"), F.round("x.value", 6).alias("value"), "x.fold")
