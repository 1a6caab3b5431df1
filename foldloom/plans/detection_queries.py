"""Queries for triggers, picks, distances, messages and times. Each has its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions import instants, shapes
from foldloom.operators import measure, pairs, stack, trigger
from foldloom.operators.series import normalize
from foldloom.plans.catalog import query
from foldloom.plans.series_queries import GRID, PARTS, grid
from foldloom.sources import messages, tables
from foldloom.sources.packets import contributions, invalid, to_packets, to_samples

HOUR = tables.HOUR_US
ON, OFF = 60.0, 30.0


def _onsets(source: str = "g", on: float = ON, off: float = OFF) -> str:
    """Triggers (id, on_, off_) of a sample table in SQL."""
    return f"""b as (select id, idx, idx - row_number() over (partition by id order by idx) as island, value from {source} where value > {off}),
t as (select id, min(idx) filter (where value > {on}) as on_, max(idx) as off_ from b group by id, island having max(value) > {on})"""


SUMMARY = """u as (select t.id, t.on_, t.off_, count(*) as npts, max(g.value) as p_max, arg_max(g.idx, (g.value, -g.idx)) as at_max, avg(g.fold) as fold_mean, min(g.fold) filter (where g.idx < t.off_) as low
from t join g on g.id = t.id and g.idx between t.on_ and t.off_ group by t.id, t.on_, t.off_)"""


@query("trigger_onset", f'{GRID}, {_onsets()} select id, on_ as "on", off_ as "off" from t')
def trigger_onset(spark: SparkSession, folder: str) -> DataFrame:
    return trigger.onsets(grid(spark, folder), ON, OFF)


@query("trigger_max_length", f'{GRID}, {_onsets("g", 40, 20)} select id, on_ as "on", off_ as "off" from t where off_ - on_ <= 3')
def trigger_max_length(spark: SparkSession, folder: str) -> DataFrame:
    return trigger.onsets(grid(spark, folder), 40.0, 20.0, max_len=3)


TRIGGER_COLUMNS = 'id, on_ as "on", off_ as "off", npts, round(p_max, 6) as p_max, at_max, round(fold_mean, 6) as fold_mean'


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("id", "on", "off", "npts", F.round("p_max", 6).alias("p_max"), "at_max", F.round("fold_mean", 6).alias("fold_mean"))


@query("trigger_summary", f"{GRID}, {_onsets()}, {SUMMARY} select {TRIGGER_COLUMNS} from u")
def trigger_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(trigger.triggers(grid(spark, folder), ON, OFF, length=256))


@query("trigger_fold_gate", f"{GRID}, {_onsets()}, {SUMMARY} select {TRIGGER_COLUMNS} from u where coalesce(low, 1e9) >= 2")
def trigger_fold_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(trigger.triggers(grid(spark, folder), ON, OFF, min_fold=2.0))


@query("trigger_bounds", f"{GRID}, {_onsets('g', 40, 20)}, {SUMMARY} select {TRIGGER_COLUMNS} from u where off_ - on_ between 2 and 6 and off_ < 474000")
def trigger_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(trigger.bounded(trigger.triggers(grid(spark, folder), 40.0, 20.0), 2, 6, 474000))


@query(
    "simple_pick",
    f"""{PARTS}, g as (select id, idx, sum(value * fold) / sum(fold) as value, sum(fold) as fold from s group by id, idx), {_onsets()}, {SUMMARY}
select id, at_max * {HOUR} as pick_us, cast((at_max - on_) * 3600 as double) as lower, cast((off_ - at_max) * 3600 as double) as upper, round((1 - {ON}::double / p_max) * 100, 4) as confidence, round(fold_mean, 6) as fold_mean from u""",
)
def simple_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: events to hourly contributions, a fold-weighed stack, triggers, and one pick each."""
    stacked = stack.stack(contributions(spark, folder), "mean")
    found = trigger.picks(trigger.triggers(stacked, ON, OFF), ON, HOUR)
    return found.select("id", "pick_us", "lower", "upper", F.round("confidence", 4).alias("confidence"), F.round("fold_mean", 6).alias("fold_mean"))


@query("pick_quality", f"""{GRID}, n as (select id, idx, value / max(abs(value)) over (partition by id) as p from g)
select id, idx, cast(case when p > 0.9 then 0 when p > 0.7 then 1 when p > 0.5 then 2 when p > 0.3 then 3 else 4 end as integer) as quality from n""")
def pick_quality(spark: SparkSession, folder: str) -> DataFrame:
    return normalize(grid(spark, folder)).select("id", "idx", shapes.quality(F.col("value")).alias("quality"))


@query("grade_bins", """select o_orderkey, cast(case when u <= 0.02 then 0 when u <= 0.03 then 1 when u <= 0.04 then 2 when u <= 0.05 then 3 else 4 end as integer) as grade from (select o_orderkey, (o_orderkey % 700) / 10000::double as u from orders)""")
def grade_bins(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "orders").select("o_orderkey", shapes.grade((F.col("o_orderkey") % 700) / 10_000).alias("grade"))


@query("pick_numbers", f'{GRID}, {_onsets()} select id, on_ as "on", cast((row_number() over (partition by id order by on_) - 1) % 50 as integer) as number from t')
def pick_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return trigger.numbered(trigger.onsets(grid(spark, folder), ON, OFF), ["on"], ["id"], 50).select("id", "on", "number")


@query(
    "topk_recent",
    f'{GRID}, {_onsets()}, r as (select *, row_number() over (partition by id order by on_ desc) as k from t) select id, on_ as "on", off_ as "off" from r where k <= 5',
)
def topk_recent(spark: SparkSession, folder: str) -> DataFrame:
    return measure.newest(trigger.onsets(grid(spark, folder), ON, OFF), 5, ["id"], "on")


@query(
    "pick_similarity",
    f"""{GRID}, {_onsets()}, {SUMMARY}, p as (select id, on_ as pick_id, cast(at_max as double) as mean, cast(greatest(off_ - on_, 1) as double) as var from u)
select a.id, a.pick_id as pick_id_1, b.pick_id as pick_id_2, round(0.5::double * (ln(b.var / a.var) + (a.var + (a.mean - b.mean) ** 2) / b.var - 1), 6) as divergence
from p a join p b on a.id = b.id and a.pick_id < b.pick_id and abs(a.mean - b.mean) <= 12""",
)
def pick_similarity(spark: SparkSession, folder: str) -> DataFrame:
    found = trigger.triggers(grid(spark, folder), ON, OFF)
    rows = found.select("id", F.col("on").alias("pick_id"), F.col("at_max").cast("double").alias("mean"), F.greatest(F.col("off") - F.col("on"), F.lit(1)).cast("double").alias("var"))
    return trigger.similar(rows, 12.0, ["id"]).select("id", "pick_id_1", "pick_id_2", F.round("divergence", 6).alias("divergence"))


def brand_stats(spark: SparkSession, folder: str) -> DataFrame:
    """key, mean, var of retail prices (in hundreds) of each brand."""
    parts = tables.table(spark, folder, "part")
    price = F.col("p_retailprice") / 100
    return parts.groupBy(F.col("p_brand").alias("key")).agg(F.avg(price).alias("mean"), F.var_pop(price).alias("var")).where("var > 0")


BRANDS = "with p as (select p_brand as key, avg(p_retailprice / 100) as mean, var_pop(p_retailprice / 100) as var from part group by 1 having var_pop(p_retailprice / 100) > 0)"
KL = "0.5::double * (ln(b.var / a.var) + (a.var + (a.mean - b.mean) ** 2) / b.var - 1)"


@query("kl_gaussian_pairs", f"{BRANDS} select a.key as key_1, b.key as key_2, round({KL}, 6) as kl from p a join p b on a.key <> b.key")
def kl_gaussian_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.all_pairs(brand_stats(spark, folder)).select("key_1", "key_2", F.round("kl", 6).alias("kl"))


@query("kl_band_join", """with p as (select s_suppkey as key, s_acctbal / 100 as mean, 1.0::double + s_suppkey % 7 as var from supplier)
select a.key as key_1, b.key as key_2, round(0.5::double * (ln(b.var / a.var) + (a.var + (a.mean - b.mean) ** 2) / b.var - 1), 6) as kl from p a join p b on a.key <> b.key and abs(a.mean - b.mean) <= 3""")
def kl_band_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") / 100).alias("mean"), (F.lit(1.0) + F.col("s_suppkey") % 7).alias("var"))
    return pairs.band_pairs(rows, 3.0).select("key_1", "key_2", F.round("kl", 6).alias("kl"))


@query("ssmd_pairs", f"{BRANDS} select a.key as key_1, b.key as key_2, round(abs(a.mean - b.mean) / sqrt(a.var + b.var), 6) as ssmd from p a join p b on a.key <> b.key")
def ssmd_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.all_pairs(brand_stats(spark, folder)).select("key_1", "key_2", F.round("ssmd", 6).alias("ssmd"))


@query("tvd", f"{BRANDS} select a.key as key_1, b.key as key_2, round(sqrt(greatest(1 - exp(-({KL})), 0)), 5) as tvd, round(1 / ({KL} + 1), 6) as score from p a join p b on a.key <> b.key")
def tvd(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.all_pairs(brand_stats(spark, folder)).select("key_1", "key_2", F.round("tvd", 5).alias("tvd"), F.round("score", 6).alias("score"))


@query("functional_forms", f"""{GRID} select id, idx, round(2 * exp(-((idx - 473500) ** 2) / (2 * 400::double)), 6) as gaussian, case when idx >= 473400 and idx < 473500 then 1.5::double else 0 end as uniform,
round(case when idx between 473400 and 473450 then 3 * (idx - 473400) / 50::double when idx > 473450 and idx <= 473600 then 3 * (473600 - idx) / 150::double else 0 end, 6) as triangle from g""")
def functional_forms(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("idx")
    return grid(spark, folder).select(
        "id", "idx", F.round(shapes.gaussian(x, 2.0, 473500, 400.0), 6).alias("gaussian"), shapes.uniform(x, 1.5, 473400, 473500).alias("uniform"), F.round(shapes.triangle(x, 3.0, 473400, 473450, 473600), 6).alias("triangle")
    )


@query("buffer_scope_late", f"""{GRID}, p as (select id, idx // 30 as n, min(idx) as start, max(idx) as "end" from g group by id, idx // 30), c as (select id, (max(idx) // 2 + min(idx) // 2) as first, max(idx) - 100 as last from g group by id)
select p.id, p.n, case when p.start > c.last then 'future' when p."end" < c.first then 'past' else 'joins' end as place from p join c on p.id = c.id""")
def buffer_scope_late(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder)
    packets = rows.groupBy("id", F.floor(F.col("idx") / 30).alias("n")).agg(F.min("idx").alias("start"), F.max("idx").alias("end"))
    half = lambda c: F.floor(c / 2)
    scopes = rows.groupBy("id").agg((half(F.max("idx")) + half(F.min("idx"))).alias("first"), (F.max("idx") - 100).alias("last"))
    return pairs.overlapping(packets, scopes).select("id", "n", "place")


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as runs of operators: name, start_us, end_us, niter."""
    orders = tables.table(spark, folder, "orders")
    start = instants.micros(F.col("o_orderdate"))
    return orders.select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("run"), start.alias("start_us"), (start + (F.col("o_orderkey") % 90 + 1) * 1_000_000).alias("end_us"), (F.col("o_custkey") % 20).alias("niter"))


RUNS = "with m as (select o_orderpriority as name, o_orderkey as run, epoch_us(o_orderdate) as start_us, epoch_us(o_orderdate) + (o_orderkey % 90 + 1) * 1000000 as end_us, o_custkey % 20 as niter from orders)"


@query("retention_filter", f"{RUNS} select name, run, start_us from m where start_us >= (select max(end_us) from m) - 30 * 86400000000")
def retention_filter(spark: SparkSession, folder: str) -> DataFrame:
    return measure.retained(run_metrics(spark, folder), 30 * tables.DAY_US).select("name", "run", "start_us")


@query(
    "run_report",
    f"""{RUNS}, r as (select name, niter, (end_us - start_us) / 1000000 as took from m)
select name, cast(sum(niter) as bigint) as niter, sum(took) as runtime, round(avg(took), 6) as mean_runtime, round(stddev_pop(took), 6) as std_runtime, min(took) as min_runtime, max(took) as max_runtime, round(sum(niter) / sum(took), 6) as rate from r group by name""",
)
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    found = measure.run_report(run_metrics(spark, folder))
    return found.withColumns({"mean_runtime": F.round("mean_runtime", 6), "std_runtime": F.round("std_runtime", 6), "rate": F.round("rate", 6)})


STAMP = """strftime(make_timestamp(cast(round_even({0} / 10000::double, 0) as bigint) * 10000), '%Y%m%d%H%M%S') || '.' || lpad(cast((cast(round_even({0} / 10000::double, 0) as bigint) * 10000 % 1000000) // 10000 as varchar), 2, '0')"""


def message_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Picks of the event series with the fields of messages."""
    found = trigger.picks(trigger.triggers(grid(spark, folder), ON, OFF), ON, HOUR)
    rows = trigger.numbered(found, ["on"], ["id"])
    return rows.select(
        F.lit(7).alias("modid"), F.lit(41).alias("orgid"), F.col("number").alias("seq"), F.lit("ALLPLACES").alias("station"), F.expr("right(id, 3)").alias("component"), F.expr("right(id, 3)").alias("channel"),
        F.lit("EV").alias("network"), F.lit("").alias("location"), F.lit("U").alias("polarity"), F.lit("P").alias("phase"), "quality", (F.col("pick_us") + F.col("on") * 1234567).alias("pick_us"),
        (F.col("p_max") * 1000).alias("amp1"), (F.col("p_max") * 1e7).alias("amp2"), F.lit(None).cast("double").alias("amp3"),
    )


ROWS = f"""{GRID}, {_onsets()}, {SUMMARY}, m as (select right(id, 3) as channel, cast((row_number() over (partition by id order by on_) - 1) % 10000 as integer) as seq, at_max * {HOUR} + on_ * 1234567 as us, p_max,
case when p_max > 0.9 then 0 when p_max > 0.7 then 1 when p_max > 0.5 then 2 when p_max > 0.3 then 3 else 4 end as q from u)"""


@query(
    "pick2k_format",
    f"""{ROWS} select channel, seq, ' 10  7 41' || lpad(cast(seq as varchar), 5, ' ') || ' ALLPLEV' || channel || ' U' || q || 'P ' || {STAMP.format("us")} || lpad(cast(cast(round_even(p_max * 1000, 0) as bigint) as varchar), 8, '0')
|| lpad(cast(cast(least(round_even(p_max * 1e7, 0), 99999999) as bigint) as varchar), 8, '0') || '00000000' || chr(10) as message from m""",
)
def pick2k_format(spark: SparkSession, folder: str) -> DataFrame:
    return messages.pick2k(message_rows(spark, folder)).select("channel", "seq", "message")


@query("pick_scnl_format", f"""{ROWS} select channel, seq, '8 7 41 ' || seq || ' ALLPLACES.' || channel || '.EV.-- U' || q || ' ' || strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%g') || ' P ' || cast(round_even(p_max * 1000, 0) as bigint) || ' ' || cast(round_even(p_max * 1e7, 0) as bigint) || ' 0' || chr(10) as message from m""")
def pick_scnl_format(spark: SparkSession, folder: str) -> DataFrame:
    return messages.pick_scnl(message_rows(spark, folder).withColumn("amp3", F.lit(0.0))).select("channel", "seq", "message")


@query("msg_code_lookup", """select event_type, case event_type_code when 0 then 'TYPE_HEARTBEAT' when 1 then 'TYPE_PICK2K' else 'TYPE_UNKNOWN' end as name, cast(case event_type_code when 0 then 3 when 1 then 10 else -1 end as integer) as code, count(*) as n
from (select event_type, event_id % 3 as event_type_code from events) group by all""")
def msg_code_lookup(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.when(F.col("event_id") % 3 == 0, "TYPE_HEARTBEAT").when(F.col("event_id") % 3 == 1, "TYPE_PICK2K").otherwise("TYPE_UNKNOWN")
    counted = tables.table(spark, folder, "events").groupBy("event_type", kinds.alias("name")).agg(F.count("*").alias("n"))
    return messages.with_code(counted).select("event_type", "name", F.coalesce("code", F.lit(-1)).alias("code"), "n")


@query("leap_epoch", """select event_id, round(epoch_us(ts) / 1000000 - 27, 6) as corrected, 1 as era from events union all
select o_orderkey, round(us / 1000000 - (select count(*) from (select unnest(['1972-07-01', '1973-01-01', '1974-01-01', '1975-01-01', '1976-01-01', '1977-01-01', '1978-01-01', '1979-01-01', '1980-01-01', '1981-07-01', '1982-07-01', '1983-07-01', '1985-07-01', '1988-01-01', '1990-01-01', '1991-01-01', '1992-07-01', '1993-07-01', '1994-07-01', '1996-01-01', '1997-07-01', '1999-01-01', '2006-01-01', '2009-01-01', '2012-07-01', '2015-07-01', '2017-01-01']) as day) where epoch_us(cast(day as timestamp)) <= us), 6), 2
from (select o_orderkey, epoch_us(o_orderdate) as us from orders)""")
def leap_epoch(spark: SparkSession, folder: str) -> DataFrame:
    made = lambda table, key, time, era: tables.table(spark, folder, table).select(F.col(key).alias("event_id"), F.round(instants.leap_corrected_epoch(instants.micros(F.col(time))), 6).alias("corrected"), F.lit(era).alias("era"))
    return made("events", "event_id", "ts", 1).unionByName(made("orders", "o_orderkey", "o_orderdate", 2))


@query("nearest_index", """select event_id, cast(round_even((epoch_us(ts) - 1704067200000000) * (1::double / 900) / 1000000, 0) as bigint) as idx from events""")
def nearest_index(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "events").select("event_id", instants.nearest_index(instants.micros(F.col("ts")), F.lit(1704067200000000), F.lit(1 / 900)).alias("idx"))


@query(
    "packet_round_trip",
    f"""{GRID}, p as (select id, idx // 48 as cut, min(idx) as a, max(idx) as b from g group by all), r as (select id, unnest(range(a, b + 1)) as idx from p)
select r.id, r.idx, round(g.value, 6) as value, coalesce(g.fold, 0) as fold from r left join g on r.id = g.id and r.idx = g.idx""",
)
def packet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    packets = to_packets(grid(spark, folder), 48, "id")
    return to_samples(packets, "id").withColumn("value", F.round("value", 6))


@query("packet_invariants", f"{GRID} select count(*) filter (where false) as broken, count(distinct (id, idx // 48)) as packets from g")
def packet_invariants(spark: SparkSession, folder: str) -> DataFrame:
    packets = to_packets(grid(spark, folder), 48, "id")
    return invalid(packets).agg(F.count("*").alias("broken")).withColumn("packets", packets.agg(F.count("*")).scalar())


@query(
    "wave_messages",
    f"""{GRID}, i as (select id, idx // 48 as cut, idx, value, idx - row_number() over (partition by id order by idx) as island from g)
select id, min(idx) * 3600::double as startt, max(idx) * 3600::double as endt, cast(count(*) as integer) as nsamp, round(sum(round_even(value, 0)), 4) as total from i group by id, cut, island""",
)
def wave_messages(spark: SparkSession, folder: str) -> DataFrame:
    packets = to_packets(grid(spark, folder), 48, "id")
    last = F.element_at(F.split("id", r"\."), -1)
    named = packets.select(
        F.lit("EV").alias("network"), F.col("id").alias("station"), F.lit("").alias("location"), last.alias("channel"), instants.instant(F.col("start") * HOUR).alias("starttime"), F.lit(1 / 3600).alias("sampling_rate"), "data", "fold"
    )
    waves = messages.packet_to_wave(named, "i4").where(messages.is_wave())
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return waves.select(F.col("station").alias("id"), F.round("startt", 2).alias("startt"), F.round("endt", 2).alias("endt"), "nsamp", F.round(total, 4).alias("total"))


@query(
    "trigger_report",
    f"""{GRID}, {_onsets("g", 40, 20)}, x as (select t.id, t.on_, t.off_, g.idx, g.value as y from t join g on g.id = t.id and g.idx between t.on_ and t.off_),
c as (select *, sum(y) over (partition by id, on_ order by idx rows unbounded preceding) / sum(y) over (partition by id, on_) as share from x),
q as (select id, on_, any_value(off_) as off_, min_by(idx, (round(abs(0.16::double - share), 12), idx)) as q16, min_by(idx, (round(abs(0.5::double - share), 12), idx)) as q50, min_by(idx, (round(abs(0.84::double - share), 12), idx)) as q84 from c group by id, on_),
m as (select id, on_, sum(y * (idx - on_)) / sum(y) as m1, sum(y * (idx - on_) ** 2) / sum(y) as m2, count(*) filter (where y <> 0) as k from x group by id, on_)
select q.id, q.on_ as "on", q.off_ as "off", q16, q50, q84, round(case when k > 1 and m2 - m1 * m1 > 0 then q.on_ + m1 end, 4) as mean, round(case when k > 1 and m2 - m1 * m1 > 0 then sqrt((m2 - m1 * m1) * k / (k - 1)) end, 4) as std
from q join m on q.id = m.id and q.on_ = m.on_""",
)
def trigger_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder)
    found = trigger.models(rows, trigger.onsets(rows, 40.0, 20.0))
    return found.select("id", "on", "off", "q16", "q50", "q84", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("pick_record_times", f"select event_id, epoch_us(ts) + cast(round_even((event_id % 50) * 1000000 / 20::double, 0) as bigint) as pick_us from events")
def pick_record_times(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events")
    params = F.create_map(F.lit("mean"), (F.col("event_id") % 50).cast("double"), F.lit("other"), F.lit(-1.0))
    rows = events.select("event_id", instants.micros(F.col("ts")).alias("reference_us"), params.alias("params"), F.lit("mean").alias("pick_param"), F.lit(20.0).alias("sampling_rate"))
    return trigger.pick_times(rows).select("event_id", "pick_us")


@query("interval_midpoints", """select o_orderkey, cast(case when o_orderkey % 3 = 0 then us when o_orderkey % 3 = 1 then floor((2 * us + 7000001) / 2) else us + 7000001 end as bigint) as pick_us from (select o_orderkey, epoch_us(o_orderdate) as us from orders)""")
def interval_midpoints(spark: SparkSession, folder: str) -> DataFrame:
    us = instants.micros(F.col("o_orderdate"))
    kind = F.col("o_orderkey") % 3
    low, high = F.when(kind == 1, us), F.when(kind != 0, us + 7000001)
    return tables.table(spark, folder, "orders").select("o_orderkey", instants.pick_micros(F.when(kind == 0, us), low, high).cast("long").alias("pick_us"))
