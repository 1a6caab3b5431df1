"""Queries for new grids, prepared windows, recursive ratios and the smaller operators on series and windows. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions import instants
from foldloom.operators import collate, dsp, regrid, select, series, stack, trigger, windows
from foldloom.plans.catalog import query
from foldloom.plans.series_queries import FILL, GRID, LISTED, OFF_TIES, PARTS, grid, instrument_windows, plain
from foldloom.sources import messages, tables
from foldloom.sources.packets import contributions, to_packets
from foldloom.streaming import processors


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return grid(spark, folder).select("id", "idx", "value", "fold")


def moved(df: DataFrame) -> DataFrame:
    """Rounded off half-way cases, as in the SQL."""
    return plain(df.withColumn("value", F.col("value") + OFF_TIES))


#: contiguous neighbours of each sample of n: b the one before, a the one ahead, t the one after that
NEAR = """case when lag(idx) over w = idx - 1 then lag(value) over w end as b, case when lead(idx) over w = idx + 1 then lead(value) over w end as a,
case when lead(idx, 2) over w = idx + 2 then lead(value, 2) over w end as t, case when lead(idx) over w = idx + 1 then lead(fold) over w end as fold2"""
MEAN = "case when {0} * {1} > 0 then 2 * {0} * {1} / ({0} + {1}) else 0 end"
SLOPES = "value + pt * (s0 + pt * (3 * (a - value) - 2 * s0 - s1 + pt * (s0 + s1 - 2 * (a - value))))"


def _on_grid(up: int, down: int, offset: int, value: str, source: str = "g", keys: str = "id") -> str:
    """r: keys, idx, value and fold of a source table on the grid (k * down + offset) / up."""
    s0, s1 = MEAN.format("(value - b)", "(a - value)"), MEAN.format("(a - value)", "(t - a)")
    return f"""n as (select *, {NEAR} from {source} window w as (partition by {keys} order by idx)),
k as (select {keys}, idx, value, fold, coalesce(a, value) as a, coalesce(fold2, fold) as fold2, case when b is null then a - value else {s0} end as s0, case when t is null then a - value else {s1} end as s1,
unnest(range((idx * {up} - ({offset}) + {down - 1}) // {down}, case when a is null then (idx * {up} - ({offset})) // {down} + 1 else ((idx + 1) * {up} - ({offset}) + {down - 1}) // {down} end)) as k from n),
f as (select *, (k * {down} + ({offset}) - idx * {up}) / {up}::double as pt from k),
r as (select {keys}, k as idx, {value} as value, fold + (fold2 - fold) * pt as fold from (select {keys}, k, idx, value, fold, a, fold2, coalesce(s0, 0) as s0, coalesce(s1, 0) as s1, pt from f))"""


MOVED = "id, idx, round(value + 0.0000314159::double, 6) as value, round(fold, 6) as fold"


@query("interp_slopes", f"{GRID}, {_on_grid(3, 2, 0, SLOPES)} select {MOVED} from r")
def interp_slopes(spark: SparkSession, folder: str) -> DataFrame:
    """Three samples in two hours, by weighed average slopes."""
    return moved(regrid.interpolated(samples(spark, folder), 3, 2, length=256))


@query("interp_any_rate", f"{GRID}, {_on_grid(10, 7, 3, 'value + (a - value) * pt')} select {MOVED} from r")
def interp_any_rate(spark: SparkSession, folder: str) -> DataFrame:
    """A sample every 42 minutes, from 18 minutes past, linear."""
    return moved(regrid.interpolated(samples(spark, folder), 10, 7, "linear", 3))


@query("interp_coarse_nearest", f"{GRID}, {_on_grid(2, 5, 1, 'case when pt <= 0.5 then value else a end')} select {MOVED} from r")
def interp_coarse_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return moved(regrid.interpolated(samples(spark, folder), 2, 5, "nearest", 1))


@query("interp_coarse_zero", f"{GRID}, {_on_grid(4, 3, 0, 'value')} select {MOVED} from r")
def interp_coarse_zero(spark: SparkSession, folder: str) -> DataFrame:
    return moved(regrid.interpolated(samples(spark, folder), 4, 3, "zero"))


@query("interp_cubic")
def interp_cubic(spark: SparkSession, folder: str) -> DataFrame:
    return plain(regrid.interpolated(samples(spark, folder), 4, 3, "cubic"))


@query("interp_quadratic")
def interp_quadratic(spark: SparkSession, folder: str) -> DataFrame:
    return plain(regrid.interpolated(samples(spark, folder), 4, 3, "quadratic"))


_KERNEL = "case when {0} = 0 then 1 else sin(pi() * {0}) / (pi() * {0}) end"
LANCZOS = f"""{_on_grid(4, 3, 0, "0")}, i as (select id, idx, value, idx - row_number() over (partition by id order by idx) as piece from g),
p as (select r.id, r.idx, r.fold, r.idx * 3 / 4::double as x, i.piece from r join i on i.id = r.id and i.idx = (r.idx * 3) // 4),
w as (select p.id, p.idx, any_value(p.fold) as fold, sum(i.value * w) as v, sum(w) as w from (select p.*, i.value, i.idx as j, ({_KERNEL.format("(p.x - i.idx)")}) * ({_KERNEL.format("((p.x - i.idx) / 20)")}) as w
from p join i on i.id = p.id and i.piece = p.piece and i.idx between (p.idx * 3) // 4 - 19 and (p.idx * 3) // 4 + 20) as i join p using (id, idx) group by p.id, p.idx)"""


@query("interp_lanczos", f"{GRID}, {LANCZOS} select id, idx, round(v / w + 0.0000314159::double, 4) as value, round(fold, 6) as fold from w")
def interp_lanczos(spark: SparkSession, folder: str) -> DataFrame:
    return regrid.interpolated(samples(spark, folder), 4, 3, "lanczos").select("id", "idx", F.round(F.col("value") + OFF_TIES, 4).alias("value"), F.round("fold", 6).alias("fold"))


@query(
    "fold_on_grid",
    f"""{GRID}, e as (select id, unnest(range(min(idx), max(idx) + 1)) as idx from g group by id),
z as (select e.id, e.idx, coalesce(g.fold, 0) as value, coalesce(g.fold, 0) as fold from e left join g on g.id = e.id and g.idx = e.idx), {_on_grid(5, 3, 2, '0', 'z')},
w as (select id, unnest(range(788800, 789501)) as idx from (select distinct id from g)) select w.id, w.idx, round(coalesce(r.fold, 0), 6) as fold from w left join r on r.id = w.id and r.idx = w.idx""",
)
def fold_on_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Folds every 36 minutes, some of them before the first sample."""
    return regrid.folds_on(samples(spark, folder), 5, 3, 2, 788_800, 789_500).withColumn("fold", F.round("fold", 6))


@query("align_values", f"{GRID}, {_on_grid(8, 8, -3, SLOPES)} select {MOVED} from r")
def align_values(spark: SparkSession, folder: str) -> DataFrame:
    """The series taken as 22.5 minutes late, interpolated at the full hours."""
    return moved(regrid.aligned(samples(spark, folder), 3, 8))


@query("align_petty", f"{GRID} select id, idx + 2 as idx, round(value, 6) as value, round(fold, 6) as fold from g")
def align_petty(spark: SparkSession, folder: str) -> DataFrame:
    return plain(regrid.aligned(samples(spark, folder), 1_997, 1_000))


@query(
    "decimate_filtered",
    f"""{GRID}, i as (select id, idx, value, fold, idx - row_number() over (partition by id order by idx) as island from g), p as (select *, min(idx) over (partition by id, island) as piece from i),
h as (select j, case when j = 0 then 1 else sin(pi() * j / 4) / (pi() * j / 4) end * (0.54::double + 0.46::double * cos(pi() * j / 40)) as h from (select unnest(range(-40, 41)) as j))
select o.id, o.piece, o.piece // 4 + (o.idx - o.piece) // 4 as idx, round(sum(x.value * h) / sum(h), 5) as value, any_value(o.fold) as fold
from p o join p x on x.id = o.id and x.piece = o.piece and x.idx between o.idx - 40 and o.idx + 40 join h on h.j = x.idx - o.idx where (o.idx - o.piece) % 4 = 0 group by o.id, o.piece, o.idx""",
)
def decimate_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth sample of each contiguous piece, after a low-pass."""
    return regrid.decimated(samples(spark, folder), 4).select("id", "piece", "idx", F.round("value", 5).alias("value"), "fold")


@query(
    "gappy_taper",
    f"""{GRID}, i as (select id, idx, value, fold, idx - row_number() over (partition by id order by idx) as island from g),
r as (select *, min(idx) over (partition by id, island) as a, max(idx) over (partition by id, island) as b from i), m as (select *, floor(least(0.2::double * (b - a + 1), (b - a + 1) / 2)) as m from r),
w as (select *, case when idx - a < m then 0.5::double - 0.5::double * cos(pi() * (idx - a) / m) else 1 end * case when b - idx < m then 0.5::double - 0.5::double * cos(pi() * (b - idx) / m) else 1 end as w from m)
select id, idx, round(value * w, 6) as value, round(fold * w, 6) as fold from w""",
)
def gappy_taper(spark: SparkSession, folder: str) -> DataFrame:
    """Split at gaps, taper each piece, merge."""
    return plain(regrid.by_piece(samples(spark, folder), series.taper, share=0.2))


@query(
    "gappy_normalize",
    f"""{GRID}, i as (select id, idx, value, fold, idx - row_number() over (partition by id order by idx) as island from g)
select id, idx, round(value / max(abs(value)) over (partition by id, island), 6) as value, fold from i""",
)
def gappy_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return plain(regrid.by_piece(samples(spark, folder), series.normalize))


#: windows of FILL prepared: each piece detrended, put on half hours by slopes, tapered by 0.25; then windows filled to 47 samples
PREPARED = f"""{FILL}, i as (select *, idx - row_number() over (partition by instrument, k, component order by idx) as island from s),
q as (select *, min(idx) over (partition by instrument, k, component, island) as piece from i),
l as (select instrument, k as win, component, piece, case when count(*) > 1 then regr_slope(value, idx) end as slope, avg(value) as level, avg(idx) as mid from q group by all),
d as (select q.instrument, q.k as win, q.component, q.piece, q.idx, q.value - (l.level + coalesce(l.slope, 0) * (q.idx - l.mid)) as value, q.fold from q join l on l.instrument = q.instrument and l.win = q.k and l.component = q.component and l.piece = q.piece),
{_on_grid(2, 1, 0, SLOPES, "d", "instrument, win, component, piece")},
e as (select *, min(idx) over u as x, max(idx) over u as y from r window u as (partition by instrument, win, component, piece)), m as (select *, floor(least(0.25::double * (y - x + 1), (y - x + 1) / 2)) as m from e),
t as (select instrument, win, component, idx, c * value as value, c * fold as fold from (select *, case when idx - x < m then 0.5::double - 0.5::double * cos(pi() * (idx - x) / m) else 1 end * case when y - idx < m then 0.5::double - 0.5::double * cos(pi() * (y - idx) / m) else 1 end as c from m)),
z as (select c.instrument, c.k as win, c.component, unnest(range(2 * (o.a + c.k * 24), 2 * (o.a + c.k * 24) + 47)) as idx from (select distinct instrument, k, component from s) c, o),
v as (select z.*, coalesce(t.value, 0) as value, coalesce(t.fold, 0) as fold from z left join t on t.instrument = z.instrument and t.win = z.win and t.component = z.component and t.idx = z.idx)"""
STEPS = {"taper": 0.25}


def _spans(placed: DataFrame) -> DataFrame:
    """First and last half-hour sample of each window of 24 hours."""
    first = F.col("anchor") + F.col("k") * 24
    return placed.select("instrument", "k", (2 * first).alias("first"), (2 * first + 46).alias("last")).distinct()


@query("window_prepared", f"{PREPARED} select instrument, win as k, component, idx, round(value + 0.0000314159::double, 5) as value, round(fold, 5) as fold from v")
def window_prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Every component of every window, prepared piece by piece, then trimmed or padded."""
    placed = instrument_windows(spark, folder)
    made = regrid.prepared(placed, 2, by=["instrument", "k", "component"], **STEPS)
    whole = collate.whole(made, _spans(placed))
    return whole.select("instrument", "k", "component", "idx", F.round(F.col("value") + OFF_TIES, 5).alias("value"), F.round("fold", 5).alias("fold"))


PASSES = f"""{PREPARED}, share as (select instrument, win, component, count(*) filter (where fold >= 0.5) / 47::double + 0.001::double >= case when component = 'P' then 0.5 else 0.7 end as ok from v group by instrument, win, component),
good as (select instrument, win, list(component) filter (where ok) as good from share group by instrument, win having list_contains(list(component) filter (where ok), 'P')),
repair as (select instrument, win, c as component, list_contains(good, c) as kept from good, (select unnest(['P', 'C', 'S']) as c))"""


@query(
    "windows_prepared",
    f"""{PASSES} select repair.instrument, repair.win as k, repair.component, v.idx, round(v.value + 0.0000314159::double, 5) as value, case when kept then round(v.fold, 5) else 0.0::double end as fold
from repair join v on v.instrument = repair.instrument and v.win = repair.win and v.component = case when kept then repair.component else 'P' end""",
)
def windows_prepared(spark: SparkSession, folder: str) -> DataFrame:
    """The same, and poor components replaced by the primary."""
    placed = instrument_windows(spark, folder)
    limits = {"primary_share": 0.5, "secondary_share": 0.7, "threshold": 0.5}
    made = regrid.prepared_windows(placed, _spans(placed), "PCS", 47, 2, thresholds=limits, **STEPS)
    return made.select("instrument", "k", "component", "idx", F.round(F.col("value") + OFF_TIES, 5).alias("value"), F.round("fold", 5).alias("fold"))


PIECES = f"""{GRID}, i as (select id, idx, value, fold, idx - row_number() over (partition by id order by idx) as island from g), p as (select *, row_number() over (partition by id, island order by idx) as j from i)"""


@query(
    "recursive_stalta",
    f"""{PIECES.replace("with g", "with recursive g")}, u as (select id, island, idx, fold, j, value * value / 3 as s, value * value / 12 as l from p where j = 1 union all
select p.id, p.island, p.idx, p.fold, p.j, u.s + (p.value * p.value - u.s) / 3, u.l + (p.value * p.value - u.l) / 12 from u join p on p.id = u.id and p.island = u.island and p.j = u.j + 1)
select id, idx, round(case when j > 12 and l > 0 then s / l else 0 end, 6) as value, fold from u""",
)
def recursive_stalta(spark: SparkSession, folder: str) -> DataFrame:
    return plain(dsp.characteristic(samples(spark, folder), "recstalta", 3, 12))


@query(
    "delayed_stalta",
    f"""{PIECES}, m as (select *, avg(value * value) over (partition by id, island order by j rows between 2 preceding and current row) as s, avg(value * value) over (partition by id, island order by j rows between 14 preceding and 3 preceding) as l from p)
select id, idx, round(case when j >= 15 and l > 0 then s / l else 0 end, 6) as value, fold from m""",
)
def delayed_stalta(spark: SparkSession, folder: str) -> DataFrame:
    return plain(dsp.characteristic(samples(spark, folder), "delayedstalta", 3, 12))


@query(
    "carl_trigger",
    f"""{PIECES}, a as (select *, avg(value) over (partition by id, island order by j rows between 2 preceding and current row) as sta from p),
b as (select *, avg(sta) over (partition by id, island order by j rows between 11 preceding and current row) as lta from a),
c as (select *, avg(abs(value - lta)) over (partition by id, island order by j rows between 2 preceding and current row) as star from b),
d as (select *, avg(star) over (partition by id, island order by j rows between 11 preceding and current row) as ltar from c)
select id, idx, round(star - 0.8::double * ltar - abs(sta - lta) - 0.8::double + 0.0000314159::double, 4) as value, fold from d""",
)
def carl_trigger(spark: SparkSession, folder: str) -> DataFrame:
    found = dsp.characteristic(samples(spark, folder), "carlstatrig", 3, 12)
    return found.select("id", "idx", F.round(F.col("value") + OFF_TIES, 4).alias("value"), "fold")


@query(
    "extend_merge",
    f"""{PARTS}, b as (select * from s union all select id, idx, value + 1, fold from s where idx % 2 = 0 union all select id, idx + 100000, value, fold from s)
select id, idx, round(sum(value * fold) / sum(fold), 6) as value, sum(fold) as fold from b group by id, idx""",
)
def extend_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A table extended by samples that partly meet it and partly are new."""
    rows = contributions(spark, folder)
    late = rows.withColumn("idx", F.col("idx") + 100_000)
    return plain(stack.extend(rows, rows.where("idx % 2 = 0").withColumn("value", F.col("value") + 1).unionByName(late)))


@query(
    "stack_identical",
    f"""{GRID}, p as (select id, idx // 24 as day, list(value order by idx) as v, list(fold order by idx) as f, min(idx) as start, max(idx) as stop from g group by all having max(idx) - min(idx) + 1 = count(*)),
x as (select id, start, v, unnest(f) as f, unnest(range(len(f))) as j from p union all select id, start, v, unnest(f) as f, unnest(range(len(f))) as j from p where day % 2 = 0)
select id, start, j, sum(f) as fold, count(*) as copies from x group by all""",
)
def stack_identical(spark: SparkSession, folder: str) -> DataFrame:
    """Whole days, every other one twice: equal packets become one with the sum of their folds."""
    days = to_packets(samples(spark, folder), 24, "id").where(F.forall("data", lambda x: x.isNotNull())).select("id", "start", "data", "fold")
    twice = days.unionByName(days.where(F.floor(F.col("start") / 24) % 2 == 0))
    made = stack.collapse_identical(twice)
    copies = F.when(F.floor(F.col("start") / 24) % 2 == 0, 2).otherwise(1).cast("long")
    return made.select("id", "start", copies.alias("copies"), F.posexplode("fold").alias("j", "fold")).withColumn("j", F.col("j").cast("long"))


@query("cast_integer", f"{GRID} select id, idx, cast(trunc(value) as integer) as value, cast(fold as integer) as fold from g")
def cast_integer(spark: SparkSession, folder: str) -> DataFrame:
    return stack.cast_values(samples(spark, folder), "int")


@query(
    "unmergeable_ids",
    """with p as (select event_type as id, case when event_type = 'click' and user_id % 2 = 0 then 20 else 10 end::double as sampling_rate, case when event_type = 'view' then event_id % 3 else 1 end::double as calib from events)
select id, count(distinct sampling_rate) as rates, count(distinct calib) as calibs from p group by id having count(distinct sampling_rate) > 1 or count(distinct calib) > 1""",
)
def unmergeable_ids(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.when((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0), 20.0).otherwise(10.0)
    calib = F.when(F.col("event_type") == "view", (F.col("event_id") % 3).cast("double")).otherwise(1.0)
    packets = tables.table(spark, folder, "events").select(F.col("event_type").alias("id"), rate.alias("sampling_rate"), calib.alias("calib"))
    return select.unmergeable(packets)


@query("primary_samples", f"{GRID} select {LISTED} from g where id = 'EV.ALL..EVP'")
def primary_samples(spark: SparkSession, folder: str) -> DataFrame:
    return plain(collate.primary_of(samples(spark, folder), "EV.ALL..EVP"))


@query("component_order", f"{GRID} select {LISTED} from g where id in ('EV.ALL..EVP', 'EV.ALL..EVC', 'EV.ALL..EVS')")
def component_order(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of a primary and of its secondaries, by the ids derived from the primary's."""
    return plain(select.lookup(tables.event_samples(spark, folder).select("id", "idx", "value", "fold", *_codes()), "id", *collate.component_ids("EV.ALL..EVP", "CSP")))


def _codes() -> list:
    parts = F.split("id", r"\.")
    return [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("network", "station", "location", "channel"))] + [F.lit("").alias("model"), F.lit("").alias("weight")]


@query("windows_merged", f"{FILL} select instrument, component, idx, round(value, 6) as value, fold * 2 as fold from s where idx >= (select a + 12 from o) union all select instrument, component, idx, round(value, 6), fold from s where idx < (select a + 12 from o)")
def windows_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping windows of 24 every 12 merged again: all but the first half window lie in two."""
    rows = grid(spark, folder).where("component in ('P', 'C', 'S')").drop("id")
    placed = windows.placed(rows, ["instrument"], F.col("component") == "P", 24, 12)
    return collate.merge_windows(placed).select("instrument", "component", "idx", F.round("value", 6).alias("value"), "fold")


@query(
    "waves_to_packets",
    f"""{GRID}, i as (select id, idx, value, idx - row_number() over (partition by id order by idx) as island from g),
w as (select id, idx // 48 as cut, island, min(idx) as a, count(*) as n, sum(value) as total from i group by all)
select id, a * 3600 as start_s, n::integer as npts, n::double as folds, round(total + 0.0000314159::double, 4) as total from w where n % 3 <> 0""",
)
def waves_to_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Wave messages, those of a number of samples divisible by 3 cut short on purpose, as packets of the sound ones."""
    made = to_packets(samples(spark, folder), 48, "id")
    named = made.select(F.lit("EV").alias("network"), F.col("id").alias("station"), F.lit("").alias("location"), F.lit("EVX").alias("channel"), instants.instant(F.col("start") * tables.HOUR_US).alias("starttime"), F.lit(1 / 3600).alias("sampling_rate"), "data", "fold")
    waves = messages.packet_to_wave(named, "f4").withColumn("data", F.when(F.col("nsamp") % 3 == 0, F.slice("data", 1, F.size("data") - 1)).otherwise(F.col("data")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    sound = messages.wave_to_packet(waves)
    return sound.select(F.col("station").alias("id"), (instants.micros(F.col("starttime")) / 1_000_000).cast("long").alias("start_s"), "npts", total("fold").alias("folds"), F.round(total("data") + OFF_TIES, 4).alias("total"))


@query("unmuted_triggers", f"{GRID}, m as (select max(idx) as newest from g), t as (select id, idx as \"on\", idx + 2 as \"off\" from g where value > 60) select id, \"on\", \"off\" from t, m where \"off\" < newest - 100")
def unmuted_triggers(spark: SparkSession, folder: str) -> DataFrame:
    rows = samples(spark, folder)
    found = rows.where("value > 60").select("id", F.col("idx").alias("on"), (F.col("idx") + 2).alias("off"))
    return processors.unmuted(found, rows.agg(F.max("idx")).scalar(), 100)


@query(
    "tables_equal",
    """with a as (select event_id, value from events), b as (select event_id, value from events where event_id % 1000 <> 7), c as (select event_id, value from events union all select event_id, value from events where event_id = 3)
select 'itself' as name, not exists (select * from a except all select * from a) as same union all select 'rows lost', not exists (select * from a except all select * from b) and not exists (select * from b except all select * from a)
union all select 'a row twice', not exists (select * from a except all select * from c) and not exists (select * from c except all select * from a)""",
)
def tables_equal(spark: SparkSession, folder: str) -> DataFrame:
    """A table against itself, against one with fewer rows, and against one with a row repeated; both ways each."""
    rows = tables.table(spark, folder, "events").select("event_id", "value")
    others = {"itself": rows, "rows lost": rows.where("event_id % 1000 <> 7"), "a row twice": rows.unionByName(rows.where("event_id = 3"))}
    return spark.createDataFrame([(name, select.equal(rows, other)) for name, other in others.items()], "name string, same boolean")


#: triggers over 40 and 20 with their samples: x
INSIDE = f"""{GRID}, b as (select id, idx, idx - row_number() over (partition by id order by idx) as island, value from g where value > 20),
t as (select id, min(idx) filter (where value > 40) as on_, max(idx) as off_ from b group by id, island having max(value) > 40),
m as (select t.id, on_, off_, arg_max(idx, (value, -idx)) as top, count(*) as n from t join g on g.id = t.id and g.idx between on_ and off_ group by all),
x as (select m.*, g.idx, g.value as y, case when g.idx <= top then (g.idx - on_ + 1) / (top - on_ + 1)::double else (off_ + 1 - g.idx) / (off_ + 1 - top)::double end as tri from m join g on g.id = m.id and g.idx between on_ and off_)"""


@query(
    "trigger_shapes",
    f"""{INSIDE}, h as (select id, on_, any_value(off_) as off_, any_value(top) as top, avg(y) as box, sum(y * tri) / sum(tri * tri) as triangle from x group by id, on_)
select h.id, h.on_ as "on", h.off_ as "off", h.top, round(box, 6) as box_height, round(sqrt(sum((y - box) ** 2)), 5) as box_l2, round(triangle, 6) as triangle_height, round(sqrt(sum((y - triangle * tri) ** 2)), 5) as triangle_l2
from h join x on x.id = h.id and x.on_ = h.on_ group by all""",
)
def trigger_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Least-squares heights of a box and of a triangle over each trigger."""
    rows = samples(spark, folder)
    found = trigger.fitted_shapes(rows, trigger.triggers(rows, 40.0, 20.0))
    return found.select("id", "on", "off", "top", F.round("box_height", 6).alias("box_height"), F.round("box_l2", 5).alias("box_l2"), F.round("triangle_height", 6).alias("triangle_height"), F.round("triangle_l2", 5).alias("triangle_l2"))

