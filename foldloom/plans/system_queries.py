"""Queries for storing and replaying, checking, grading, catalogues and declared pipelines. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions import checks, instants, shapes
from foldloom.operators import measure, predict, stack, windows
from foldloom.plans import pipeline
from foldloom.plans.catalog import query
from foldloom.plans.detection_queries import ROWS, STAMP, message_rows
from foldloom.plans.series_queries import GRID, LISTED, OFF_TIES, grid, plain
from foldloom.plans.stream_queries import finished
from foldloom.sources import messages, miniseed, packets, scratch, store, tables

HOUR = tables.HOUR_US


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder).select("id", "idx", "value", "fold", F.lit("EV").alias("network"), F.col("component").alias("station"))
    return store.with_day(rows, F.col("idx") * HOUR)


DAY = "strftime(make_timestamp(idx * 3600000000), '%Y-%m-%d')"


@query("store_round_trip", f"{GRID} select {LISTED}, component as station, {DAY} as day from g where component in ('P', 'S') and {DAY} between '2024-01-05' and '2024-01-20'")
def store_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Samples written by station and day into a shared folder, and some of its folders read again."""
    path = scratch.new_folder(spark, "store")
    store.write(_dated(spark, folder), path)
    back = store.read(spark, path, F.col("station").isin("P", "S") & F.col("day").between("2024-01-05", "2024-01-20"))
    return back.select("id", "idx", F.round("value", 6).alias("value"), F.round("fold", 6).alias("fold"), "station", F.col("day").cast("string").alias("day"))


@query("store_replay", f"{GRID} select component as station, count(*) as n, round(sum(value) + 0.0000314159::double, 4) as total, min(idx) as first, max(idx) as last from g group by component")
def store_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Stored samples played back as a stream, a few files a batch, and summed up over all of it."""
    path = scratch.new_folder(spark, "store")
    rows = _dated(spark, folder).select("station", "idx", "value")
    rows.repartition(12, "idx").write.parquet(path)
    played = store.replay(spark, path, rows.schema, files_per_batch=4)
    done = finished(played.groupBy("station").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("idx").alias("first"), F.max("idx").alias("last")), "complete")
    return done.select("station", "n", F.round(F.col("total") + OFF_TIES, 4).alias("total"), "first", "last")


@query("arrival_batches", "select (epoch_us(ts) + (event_id % 7) * 40000000) // 3600000000 as batch, count(*) as n, min(event_id) as first from events group by 1")
def arrival_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Events by the hour in which each would have arrived, up to four minutes late."""
    events = tables.table(spark, folder, "events")
    arrival = tables.micros(F.col("ts")) + (F.col("event_id") % 7) * 40_000_000
    return store.by_arrival(events, arrival, HOUR).groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("concat_series", f"{GRID} select {LISTED} from g union all select {LISTED} from g where component = 'P'")
def concat_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder)
    return plain(rows.unionByName(rows.where("component = 'P'")))


@query(
    "packet_checks",
    """with p as (select event_id, event_id % 2 = 0 as folded, case when event_id % 11 = 0 then '' else 'EV' end as network, case when event_id % 13 = 0 then 0 else 20 end as sampling_rate, event_id % 17 = 0 as timeless, event_id % 5 as n, case when event_id % 19 = 0 then 1 else 0 end as short from events),
r as (select case when network = '' then 'codes' when sampling_rate = 0 then 'sampling_rate' when timeless then 'starttime' when n = 0 then 'data' when folded and short = 1 then 'fold' else 'none' end as reason from p)
select reason, count(*) as n from r group by reason""",
)
def packet_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, some broken on purpose, by the reason why they can't be packets."""
    event = F.col("event_id")
    data = F.slice(F.array(*[F.lit(float(k)) for k in range(5)]), 1, (event % 5).cast("int"))
    fold = F.when(event % 2 == 0, F.transform(F.slice(data, 1, F.greatest(F.size(data) - F.when(event % 19 == 0, 1).otherwise(0), F.lit(0))), lambda _: F.lit(1.0)))
    rows = tables.table(spark, folder, "events").select(
        F.when(event % 11 == 0, "").otherwise("EV").alias("network"), F.lit("ALL").alias("station"), F.lit("").alias("location"), F.lit("EVX").alias("channel"),
        F.when(event % 13 == 0, 0.0).otherwise(20.0).alias("sampling_rate"), F.when(event % 17 != 0, F.col("ts")).alias("starttime"), data.alias("data"), fold.alias("fold"),
    )
    return rows.groupBy(F.coalesce(packets.rejection(), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("packets_accepted", "select event_id % 5 as size, count(*) as n from events where event_id % 5 > 0 and event_id % 11 > 0 group by 1")
def packets_accepted(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    data = F.slice(F.array(*[F.lit(float(k)) for k in range(5)]), 1, (event % 5).cast("int"))
    rows = tables.table(spark, folder, "events").select(
        F.when(event % 11 > 0, "EV").alias("network"), F.lit("ALL").alias("station"), F.lit("").alias("location"), F.lit("EVX").alias("channel"),
        F.lit(20.0).alias("sampling_rate"), F.col("ts").alias("starttime"), data.alias("data"), F.transform(data, lambda _: F.lit(1.0)).alias("fold"),
    )
    return packets.accepted(rows).groupBy(F.size("data").cast("long").alias("size")).agg(F.count("*").alias("n"))


GRADED = "case when u <= 0.02 then 0 when u <= 0.03 then 1 when u <= 0.04 then 2 when u <= 0.05 then 3 else 4 end"


@query(
    "pick2k_graded",
    f"""{ROWS.replace(" as q from u)", " as q, case when seq_ % 6 < 5 then (seq_ % 6) / 80::double end as u from u0)").replace("m as (select right(id, 3) as channel,", "u0 as (select *, (row_number() over (partition by id order by on_) - 1) % 10000 as seq_ from u), m as (select right(id, 3) as channel,")}
select channel, seq, ' 10  7 41' || lpad(cast(seq as varchar), 5, ' ') || ' ALLPLEV' || channel || ' U' || {GRADED} || 'P ' || {STAMP.format("us")} || lpad(cast(cast(round_even(p_max * 1000, 0) as bigint) as varchar), 8, '0')
|| lpad(cast(cast(least(round_even(p_max * 1e7, 0), 99999999) as bigint) as varchar), 8, '0') || '00000000' || chr(10) as message from m""",
)
def pick2k_graded(spark: SparkSession, folder: str) -> DataFrame:
    """PICK2K lines whose quality is the grade of an uncertainty; one in six has none."""
    rows = message_rows(spark, folder).withColumn("uncertainty", F.when(F.col("seq") % 6 < 5, (F.col("seq") % 6) / F.lit(80.0)))
    return messages.graded_pick2k(rows).select("channel", "seq", "message")


@query(
    "value_checks",
    """select p_partkey, p_size between 5 and 20 as sized, p_retailprice = floor(p_retailprice) and p_retailprice > 950 as whole, len(list_distinct(string_split(p_brand, ''))) = length(p_brand) as single, p_size % 4 = 0 as missing, regexp_full_match(p_brand, '([A-Z][a-z0-9]*)+') as camel
from (select p_partkey, p_size, p_retailprice, replace(p_brand, '#', '') as p_brand from part)""",
)
def value_checks(spark: SparkSession, folder: str) -> DataFrame:
    brand, size = F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.col("p_size")
    text = F.when(size % 4 == 0, F.when(size % 8 == 0, " None ").otherwise("")).otherwise("x")
    return tables.table(spark, folder, "part").select(
        "p_partkey",
        checks.bounded(size, 5, 20).alias("sized"),
        checks.whole(F.col("p_retailprice"), 950, inclusive=False).alias("whole"),
        checks.single_characters(brand).alias("single"),
        checks.stands_for_none(text).alias("missing"),
        checks.camel_case(brand).alias("camel"),
    )


_DENSITY = "case when x <= {1} then 2 * (x - {0}) / (({2} - {0}) * ({1} - {0})) else 2 * ({2} - x) / (({2} - {0}) * ({2} - {1})) end"
_FIRST, _SECOND = _DENSITY.format("a", "b", "c"), _DENSITY.format("d", "e", "f")


@query(
    "kl_triangle",
    f"""with p as (select distinct p_size, 0::double as a, p_size::double as b, 60::double as c, (-1)::double as d, 30::double as e, 61.5::double as f from part), x as (select *, a + (k - 0.5::double) * (c - a) / 400 as x from p, (select unnest(range(1, 401)) as k)),
q as (select *, {_FIRST} as p1, {_SECOND} as p2 from x) select p_size, round(sum(p1 * ln(p1 / p2)) * any_value((c - a) / 400), 6) as kl from q where p1 > 0 and p2 > 0 group by p_size""",
)
def kl_triangle(spark: SparkSession, folder: str) -> DataFrame:
    """Divergences of triangular densities from one that holds them, by quadrature."""
    rows = tables.table(spark, folder, "part").select("p_size").distinct()
    of = lambda *v: tuple(F.lit(float(x)) if isinstance(x, int | float) else x for x in v)
    divergence = shapes.kl_triangle(of(0, F.col("p_size").cast("double"), 60), of(-1, 30, 61.5))
    return rows.select("p_size", F.round(divergence, 6).alias("kl"))


@query(
    "stop_reasons",
    """with r as (select o_orderkey, o_orderkey % 4 as in_init, 1 + o_custkey % 10 as done, case o_orderkey % 7 when 1 then 'get' when 2 then 'run' when 3 then 'put' end as halted, 10 as max_iter from orders),
s as (select *, case when in_init = 0 then 'nodata' when halted is not null then 'early-' || halted else 'max' end as stop, case when in_init = 0 then 0 when halted = 'put' then done when halted is not null then done - 1 else max_iter end as niter from r)
select stop, count(*) as runs, sum(niter)::bigint as iterations from s group by stop""",
)
def stop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    halted = F.when(key % 7 == 1, "get").when(key % 7 == 2, "run").when(key % 7 == 3, "put")
    runs = tables.table(spark, folder, "orders").select((key % 4).alias("in_init"), (1 + F.col("o_custkey") % 10).alias("done"), halted.alias("halted"), F.lit(10).alias("max_iter"))
    return measure.stop_reasons(runs).groupBy("stop").agg(F.count("*").alias("runs"), F.sum("niter").alias("iterations"))


_WEIGHTS = ", ".join(f"('{m}', '{w}')" for m, weights in predict.CATALOGUE.items() for w in weights)


@query(
    "model_catalogue",
    f"""{GRID}, l as (select id, max(idx) - min(idx) + 1 as span from g group by id) select id, model, weight, n as window_npts, n - 6 as step, cast(greatest(floor((span - n) / (n - 6)::double) + 1, 0) as bigint) as windows
from (values {_WEIGHTS}) t(model, weight) join (values ('EQTransformer', 24), ('PhaseNet', 12)) s(name, n) on name = model, l""",
)
def model_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """How many windows each published weight is asked for over each series, with the sizes of the models' windows at an overlap of six samples."""
    made = [predict.window_parameters(n, 2, 6) | {"name": m} for m, n in (("EQTransformer", 24), ("PhaseNet", 12))]
    sizes = spark.createDataFrame([(p["name"], p["in_samples"], p["step"]) for p in made], "model string, window_npts int, step int")
    asked = predict.catalogue(spark).join(F.broadcast(sizes), "model")
    spans = stack.span(grid(spark, folder)).select("id", (F.col("last") - F.col("first") + 1).alias("span"))
    count = F.greatest(F.floor((F.col("span") - F.col("window_npts")) / F.col("step")) + 1, F.lit(0)).cast("long")
    return spans.crossJoin(F.broadcast(asked)).select("id", "model", "weight", "window_npts", "step", count.alias("windows"))


@query(
    "model_windows",
    """select p_partkey, n as in_samples, o as overlap, round(n / 100::double, 6) as length, round((n - o) / 100::double, 6) as step, round(3 * n / 100::double - 2 * (n - o) / 100::double, 6) as delay
from (select p_partkey, 1000 + 100 * p_size as n, p_partkey % 900 as o from part)""",
)
def model_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds of length, step and delay for sizes and overlaps from a table."""
    sizes = tables.table(spark, folder, "part").select("p_partkey", (1000 + 100 * F.col("p_size")).alias("in_samples"), (F.col("p_partkey") % 900).alias("overlap"))
    made = windows.model_seconds(F.col("in_samples"), F.lit(100.0), F.col("overlap"), 3)
    return sizes.select("*", *[F.round(c, 6).alias(name) for name, c in made.items()])


CONFIG = {
    "Level": {"norm": "max"},
    "Trim": {"CLASS": "trim", "first": "473300", "last": "473700", "pad": "False"},
    "Norm": {"CLASS": "normalize", "how": "${Level:norm}"},
    "Drop": {"CLASS": "decimate", "factor": "3"},
}


@query(
    "declared_pipeline",
    f"""{GRID}, t as (select * from g where idx between 473300 and 473700), m as (select *, value / max(abs(value)) over (partition by id) as v, min(idx) over (partition by id) as a from t)
select id, a // 3 + (idx - a) // 3 as idx, round(v, 6) as value, fold from m where (idx - a) % 3 = 0""",
)
def declared_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """A sequence of operators named by a configuration, with references and written values."""
    steps = [(name, *pipeline.section(CONFIG, name)) for name in ("Trim", "Norm", "Drop")]
    made = pipeline.declared([{"name": name, "operator": chosen, "arguments": arguments, "needs": ["id", "idx", "value"]} for name, chosen, arguments in steps])
    return plain(made.run(grid(spark, folder).select("id", "idx", "value", "fold")))


@query(
    "config_values",
    """select n_name as name, case n_nationkey % 5 when 0 then 'int' when 1 then 'float' when 2 then 'bool' when 3 then 'list' else 'str' end as kind,
case n_nationkey % 5 when 0 then cast(n_nationkey as varchar) when 1 then cast(n_nationkey / 4::double as varchar) when 2 then 'True' when 3 then '[' || n_nationkey || ', ''x'']' else 'import ' || n_name end as value from nation""",
)
def config_values(spark: SparkSession, folder: str) -> DataFrame:
    """Written parameters, one a nation, as the values they stand for; half of them by reference to another section."""
    nations = tables.table(spark, folder, "nation").select("n_name", "n_nationkey").collect()  # a table of fixed size
    write = (lambda k, n: str(k), lambda k, n: str(k / 4), lambda k, n: "true", lambda k, n: f"[{k}, 'x']", lambda k, n: f"import {n}")
    written = {n: write[k % 5](k, n) for n, k in nations}
    section = {n: f"${{Other:{n}}}" if k % 2 else written[n] for n, k in nations}
    _, values = pipeline.section({"Nations": {"CLASS": "any", **section}, "Other": written}, "Nations")
    return spark.createDataFrame([(k, type(v).__name__, str(v)) for k, v in values.items()], "name string, kind string, value string")


@query("collapsed_twice", f"{GRID} select {LISTED} from g")
def collapsed_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Stacking a series alone changes nothing, whatever the method."""
    rows = grid(spark, folder).select("id", "idx", "value", "fold")
    return plain(stack.stack(stack.stack(rows, "max"), "drop"))


@query(
    "miniseed_round_trip",
    f"""{GRID}, w as (select 'EV.ALL..' || right(id, 3) as id, idx, round_even(value * 100, 0) as value from g), r as (select id, unnest(range(min(idx), max(idx) + 1)) as idx from w group by id)
select r.id, r.idx, w.value, case when w.value is null then 0.0::double else 1 end as fold from r left join w on w.id = r.id and w.idx = r.idx""",
)
def miniseed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The event series in whole numbers as miniSEED files (Steim-2), read back with gaps masked."""
    packed = packets.to_packets(grid(spark, folder).withColumn("value", F.rint(F.col("value") * 100)), 48, "id")
    named = packed.select(
        F.lit("EV").alias("network"), F.lit("ALL").alias("station"), F.lit("").alias("location"), F.expr("right(id, 3)").alias("channel"), instants.instant(F.col("start") * HOUR).alias("starttime"), F.lit(1 / 3600).alias("sampling_rate"), "data", "fold"
    )
    waves = messages.packet_to_wave(named, "i4")
    miniseed.register(spark)
    path = scratch.new_folder(spark, "seed")
    location = F.when(F.col("location") == "--", "").otherwise(F.col("location"))
    waves.select("network", "station", location.alias("location"), "channel", "startt", "samprate", "nsamp", F.col("data").cast("array<double>").alias("data")).write.format("miniseed").mode("append").option("recordLength", 512).save(path)
    back = miniseed.samples(spark.read.format("miniseed").option("splitBytes", 8192).load(path), HOUR)
    return stack.fill_gaps(back).select("id", "idx", "value", "fold")
