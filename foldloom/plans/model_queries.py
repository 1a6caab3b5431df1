"""Queries for fitted corners, places of change, bridged series, scorers with weights and the repeatable sink. Each has its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.operators import collate, convnet, corners, onset, stack, trigger, windows
from foldloom.operators.frames import in_spans
from foldloom.plans.catalog import query
from foldloom.plans.detection_queries import _onsets
from foldloom.plans.live_queries import HOUR, events_live, samples_live
from foldloom.plans.series_queries import GRID, LISTED, OFF_TIES, grid, plain
from foldloom.plans.signal_queries import SHARES, _scores, instrument_windows
from foldloom.sources import scratch, store


def spans(spark: SparkSession, folder: str, before: int, after: int) -> DataFrame:
    """The samples of each trigger and of what lies around it, with id and on."""
    rows = grid(spark, folder).select("id", "idx", "value", "fold")
    found = trigger.onsets(rows, 40.0, 20.0, max_len=200)
    return in_spans(rows, found.select("id", (F.col("on") - before).alias("first"), (F.col("off") + after).alias("last"), "on"), ["id"])


def _spans(before: int, after: int) -> str:
    """x: id, on_, idx, y of the same samples in SQL."""
    return f"{GRID}, {_onsets('g', 40, 20)}, x as (select t.id, t.on_, g.idx, g.value as y from t join g on g.id = t.id and g.idx between t.on_ - {before} and t.off_ + {after} where t.off_ - t.on_ <= 200), n as (select id, on_, min(idx) as a, max(idx) as b from x group by all having count(*) >= 3)"


@query("trigger_cut", f'{GRID}, {_onsets("g", 40, 20)} select id, on_ as "on", least(off_, on_ + 3) as "off" from t')
def trigger_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Triggers, long ones cut at their longest length instead of dropped."""
    return trigger.onsets(grid(spark, folder), 40.0, 20.0, max_len=3, cut=True)


@query(
    "trigger_corners",
    f"""{_spans(2, 2)}, q as (select n.id, n.on_, p.idx as a, r.idx as b from n join x p on p.id = n.id and p.on_ = n.on_ join x r on r.id = n.id and r.on_ = n.on_ and r.idx >= p.idx),
bg as (select q.id, q.on_, q.a, q.b, sum(x.y) as s, count(*) as k from q join x on x.id = q.id and x.on_ = q.on_ and x.idx between q.a and q.b group by all having sum(x.y) > 0),
bx as (select id, on_, unnest(max_by({{'a': a, 'b': b, 'h': s / k, 'gain': s * s / k}}, (round(s * s / k, 6), -a, -b))) from bg group by id, on_),
c as (select n.id, n.on_, o.o as a, p.p, e.e as b from n, lateral (select unnest(range(n.a, n.b - 1)) as o) o, lateral (select unnest(range(o.o + 1, n.b)) as p) p, lateral (select unnest(range(p.p + 1, n.b + 1)) as e) e),
w as (select c.*, x.y, case when x.idx <= c.p then (x.idx - c.a) / (c.p - c.a)::double else (c.b - x.idx) / (c.b - c.p)::double end as t from c join x on x.id = c.id and x.on_ = c.on_ and x.idx between c.a and c.b),
tg as (select id, on_, a, p, b, sum(y * t) as s, sum(t * t) as k from w group by all having sum(y * t) > 0 and sum(t * t) > 1e-9),
tr as (select id, on_, unnest(max_by({{'o': a, 'p': p, 'e': b, 'h': s / k, 'gain': s * s / k}}, (round(s * s / k, 6), -p, -a, -b))) from tg group by id, on_),
y as (select id, on_, sum(y * y) as total from x group by all)
select n.id, n.on_ as "on", bx.a as box_first, bx.b as box_last, round(bx.h + {OFF_TIES}::double, 5) as box_height, round(sqrt(greatest(y.total - bx.gain, 0)) + {OFF_TIES}::double, 3) as box_l2, tr.o as onset, tr.p as peak, tr.e as "offset", round(tr.h + {OFF_TIES}::double, 5) as triangle_height, round(sqrt(greatest(y.total - tr.gain, 0)) + {OFF_TIES}::double, 3) as triangle_l2
from n join y on y.id = n.id and y.on_ = n.on_ left join bx on bx.id = n.id and bx.on_ = n.on_ left join tr on tr.id = n.id and tr.on_ = n.on_""",
)
def trigger_corners(spark: SparkSession, folder: str) -> DataFrame:
    """A box and a triangle for each trigger, over two samples more on both sides, by their corners of least squares."""
    found = corners.fits(spans(spark, folder, 2, 2))
    rounded = {c: F.round(F.col(c) + OFF_TIES, n) for c, n in (("box_height", 5), ("box_l2", 3), ("triangle_height", 5), ("triangle_l2", 3))}
    return found.select("id", "on", "box_first", "box_last", "onset", "peak", "offset", *[v.alias(c) for c, v in rounded.items()])


@query(
    "aic_places",
    f"""{_spans(12, 3)}, c as (select *, y - avg(y) over (partition by id, on_) as v from x),
s as (select id, on_, idx, count(*) over p as k, sum(v) over p as s, sum(v * v) over p as q, count(*) over (partition by id, on_) as n, sum(v) over (partition by id, on_) as sa, sum(v * v) over (partition by id, on_) as qa from c
window p as (partition by id, on_ order by idx rows between unbounded preceding and 1 preceding)),
a as (select id, on_, idx, k * ln(greatest(q / k - (s / k) ** 2, 1e-10)) + (n - k - 1) * ln(greatest((qa - q) / (n - k) - ((sa - s) / (n - k)) ** 2, 1e-10)) as aic from s where k >= 2 and n - k >= 2)
select id, on_ as "on", arg_min(idx, (round(aic, 9), idx)) as place, round(min(aic), 4) as aic from a group by id, on_""",
)
def aic_places(spark: SparkSession, folder: str) -> DataFrame:
    """The place of change by variances around each trigger, over half a day before it."""
    return onset.variance_places(spans(spark, folder, 12, 3)).select("id", "on", "place", F.round("aic", 4).alias("aic"))


@query("ar_places")
def ar_places(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the errors of autoregressive models; these have no SQL."""
    return onset.ar_places(spans(spark, folder, 12, 6))


@query(
    "bridged_series",
    f"""{GRID}, m as (select id, (min(idx) + max(idx)) // 2 as mid from g group by id),
t as (select 'a' as side, g.id, idx, value, fold from g join m using (id) where idx <= mid + case when component = 'S' then -10 when component = 'V' then 60 else 6 end union all
select 'b', g.id, idx, value + 10, fold from g join m using (id) where idx >= mid + case when component = 'S' then 10 else -6 end and (component <> 'V' or idx <= mid + 6)),
e as (select *, case when a0 < b0 and a1 < b1 then 'a' when b0 < a0 and b1 < a1 then 'b' end as leads, greatest(a0, b0) <= least(a1, b1) as overlap, least(greatest(a0, b0), least(a1, b1)) as low, greatest(greatest(a0, b0), least(a1, b1)) as high
from (select id, min(idx) filter (where side = 'a') as a0, max(idx) filter (where side = 'a') as a1, min(idx) filter (where side = 'b') as b0, max(idx) filter (where side = 'b') as b1 from t group by id)),
f as (select e.*, case when leads is null then case when a0 <= b0 and a1 >= b1 then 'b' else 'a' end end as inner_, (select value from t where t.id = e.id and t.side = e.leads and t.idx = e.low) as v0, (select value from t where t.id = e.id and t.side <> e.leads and t.idx = e.high) as v1 from e),
o as (select t.id, t.idx, case when leads is not null and overlap and idx between low and high then v0 + (v1 - v0) * (idx - low) / greatest(high - low, 1)::double else value end as value, fold from t join f using (id) where inner_ is null or inner_ <> side union all
select id, idx, v0 + (v1 - v0) * (idx - low) / greatest(high - low, 1)::double, 0 from (select *, unnest(range(low + 1, high)) as idx from f where leads is not null and not overlap)),
z as (select id, idx, max(value) as value, sum(fold) as fold from o group by all)
select id, idx, round(value, 6) as value, round(case when value is null then 0 else fold end, 6) as fold from z""",
)
def bridged_series(spark: SparkSession, folder: str) -> DataFrame:
    """Each series cut in two: parts that overlap, parts with a gap between, and a part within the other, made one again by straight lines."""
    rows = grid(spark, folder)
    cut = rows.join(rows.groupBy("id").agg(F.floor((F.min("idx") + F.max("idx")) / 2).alias("mid")), "id")
    apart, within = F.col("component") == "S", F.col("component") == "V"
    left = cut.where(F.col("idx") <= F.col("mid") + F.when(apart, -10).when(within, 60).otherwise(6))
    right = cut.where((F.col("idx") >= F.col("mid") + F.when(apart, 10).otherwise(-6)) & (~within | (F.col("idx") <= F.col("mid") + 6))).withColumn("value", F.col("value") + 10)
    both = [side.select("id", "idx", "value", "fold") for side in (left, right)]
    return plain(stack.bridged(*both, gaps=True))


#: weights of a small net by rule: two layers, three components in, two channels, three labels out
SEEDS = {"north": 1, "south": 4}


def small_nets(spark: SparkSession) -> DataFrame:
    """A catalogue of two weights of one model."""
    rows = []
    for weight, s in SEEDS.items():
        first = [[[((o * 7 + i * 5 + j * 3 + s) % 11 - 5) / 10 for j in range(3)] for i in range(3)] for o in range(2)]
        second = [[[((o * 4 + i * 3 + s) % 7 - 3) / 5] for i in range(2)] for o in range(3)]
        rows.append(("Small", weight, 0, first, [((o + s) % 3 - 1) / 10 for o in range(2)], "relu"))
        rows.append(("Small", weight, 1, second, [((o + 2 * s) % 5 - 2) / 10 for o in range(3)], "sigmoid"))
    return spark.createDataFrame(rows, convnet.SCHEMA)


@query(
    "convnet_weights",
    f"""{_scores(24, (0.5, 0.95), {"fast": (2, 8)})}, mu as (select instrument, k, component, avg(x) as mean from t group by all),
ce as (select t.instrument, t.k, position(t.component in 'PCS') - 1 as i, t.pos, t.x - mean as c from t join mu on mu.instrument = t.instrument and mu.k = t.k and mu.component = t.component),
za as (select instrument, k, i, pos, c / greatest(max(abs(c)) over (partition by instrument, k, i), 1e-12) as z from ce), wt as (select unnest(['north', 'south']) as weight, unnest([1, 4]) as s),
hid as (select instrument, k, weight, s, o, za.pos - j + 1 as pos, sum(z * ((o * 7 + i * 5 + j * 3 + s) % 11 - 5) / 10::double) as total from za, wt, (select unnest(range(2)) as o), (select unnest(range(3)) as j) where za.pos - j + 1 between 0 and 23 group by all),
act as (select instrument, k, weight, s, o, pos, greatest(total + ((o + s) % 3 - 1) / 10::double, 0) as h from hid)
select instrument, k, weight, pos, label, round(1 / (1 + exp(-(sum(h * ((label * 4 + o * 3 + s) % 7 - 3) / 5::double) + ((label + 2 * any_value(s)) % 5 - 2) / 10::double))), 6) as value from act, (select unnest(range(3)) as label) group by instrument, k, weight, pos, label""",
)
def convnet_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every window by two weights of one small convolutional net."""
    placed = instrument_windows(spark, folder)
    filled = collate.whole(collate.fill_components(placed, 24, "PCS", "secondary", **SHARES), windows.spans(placed, ["instrument"], 24, 24))
    tensors = collate.tensor(filled, "PCS", 24)
    nets = small_nets(spark)
    scored = tensors.select("instrument", "k", F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), convnet.scores(nets, "Small", w)("tensor").alias("scores")) for w in SEEDS])).alias("y"))
    labels = scored.select("instrument", "k", "y.weight", F.posexplode("y.scores").alias("label", "values"))
    each = labels.select("instrument", "k", "weight", F.col("label").cast("long").alias("label"), F.posexplode("values").alias("pos", "value"))
    return each.select("instrument", "k", "weight", F.col("pos").cast("long").alias("pos"), "label", F.round("value", 6).alias("value"))


@query("stream_store", f"{GRID} select {LISTED} from g")
def stream_store(spark: SparkSession, folder: str) -> DataFrame:
    """Events stored by a stream into a sink that takes batches again: one is written twice, one breaks down half-way and is written anew; on the grid."""
    sink = store.BatchSink(scratch.new_folder(spark, "sink"), ("component",))
    progress = scratch.new_folder(spark, "progress")
    rows = events_live(spark, folder).where("component <> ''").select("event_id", "component", F.floor(F.unix_micros("ts") / HOUR).cast("long").alias("idx"), "value", F.lit(1.0).alias("fold"))
    broken: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        if number == 2 and not broken:
            broken.append(number)
            store.write(batch.select("event_id", "component", "idx", F.lit("value").alias("kind"), F.col("value").alias("x")), f"{sink.path}/batch={number}", ("kind", "component"), "overwrite")
            raise RuntimeError("broken down")
        sink(batch, number)
        if number == 1:
            sink(batch, number)

    def run() -> None:
        rows.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()

    try:
        run()
    except StreamingQueryException:
        run()
    back = sink.read(spark, ("event_id", "component", "idx"))
    cells = back.groupBy(F.concat(F.lit("EV.ALL..EV"), "component").alias("id"), "idx").agg(F.avg("value").alias("value"), F.sum("fold").alias("fold"))
    return plain(cells)
