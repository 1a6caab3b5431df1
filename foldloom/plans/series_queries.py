"""Queries over single series: stacking, selection, trimming, scaling, calculus, windows. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions import ids
from foldloom.operators import collate, measure, select, series, stack, windows
from foldloom.plans.catalog import query
from foldloom.sources import tables
from foldloom.sources.packets import contributions

#: the event series in SQL: g has id, instrument, component, idx, value, fold
GRID = """with g as (select 'EV.ALL..EV' || c as id, 'EV.ALL..EV' as instrument, c as component, idx, avg(value) as value, cast(count(*) as double) as fold
from (select upper(substr(event_type, 1, 1)) as c, epoch_us(ts) // 3600000000 as idx, value from events where value is not null) group by all)"""
#: users' series on the same grid as contributions to the type's series: s has id, idx, value, fold
PARTS = """with s as (select 'EV.ALL..EV' || c as id, idx, avg(value) as value, cast(count(*) as double) as fold
from (select upper(substr(event_type, 1, 1)) as c, user_id, epoch_us(ts) // 3600000000 as idx, value from events where value is not null) group by c, user_id, idx)"""
#: codes of the same series: k has the four codes and n
CODES = """with k as (select 'EV' as network, 'U' || cast(user_id as varchar) as station, '' as location, 'EV' || upper(substr(event_type, 1, 1)) as channel, '' as model, '' as weight, count(*) as n
from events group by all)"""


def grid(spark: SparkSession, folder: str) -> DataFrame:
    return tables.event_samples(spark, folder)


def plain(df: DataFrame) -> DataFrame:
    """Samples as they are compared: rounded, without the further codes."""
    return df.select("id", "idx", F.round("value", 6).alias("value"), F.round("fold", 6).alias("fold"))


def series_codes(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events").where("user_id is not null")
    codes = tables.event_codes(F.concat(F.lit("U"), F.col("user_id"))) | {"model": F.lit(""), "weight": F.lit("")}
    return events.select(*[c.alias(n) for n, c in codes.items()]).groupBy(*codes).agg(F.count("*").alias("n"))


#: many of these sums lie half-way between two rounded numbers; this moves them off, here and in the SQL
OFF_TIES = 0.0000314159
LISTED = "id, idx, round(value, 6) as value, round(fold, 6) as fold"


@query("grid_events", f"{GRID} select {LISTED} from g")
def grid_events(spark: SparkSession, folder: str) -> DataFrame:
    return plain(grid(spark, folder))


@query("stack_drop", f"{PARTS} select id, idx, round(case when count(*) = 1 then max(value) end, 6) as value, case when count(*) = 1 then max(fold) else 0.0::double end as fold from s group by id, idx")
def stack_drop(spark: SparkSession, folder: str) -> DataFrame:
    return plain(stack.stack(contributions(spark, folder), "drop"))


@query("stack_max", f"{PARTS} select id, idx, round(max(value), 6) as value, sum(fold) as fold from s group by id, idx")
def stack_max(spark: SparkSession, folder: str) -> DataFrame:
    return plain(stack.stack(contributions(spark, folder), "max"))


@query("stack_wmean", f"{PARTS} select id, idx, round(sum(value * fold) / sum(fold), 6) as value, sum(fold) as fold from s group by id, idx")
def stack_wmean(spark: SparkSession, folder: str) -> DataFrame:
    return plain(stack.stack(contributions(spark, folder), "mean"))


@query(
    "gap_fill",
    f"""{GRID}, r as (select id, unnest(range(min(idx), max(idx) + 1)) as idx from g group by id)
select r.id, r.idx, round(g.value, 6) as value, coalesce(g.fold, 0) as fold from r left join g on r.id = g.id and r.idx = g.idx""",
)
def gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    return plain(stack.fill_gaps(grid(spark, folder).select("id", "idx", "value", "fold")))


@query(
    "split_islands",
    f"""{GRID}, i as (select id, idx, idx - row_number() over (partition by id order by idx) as island from g)
select id, min(idx) as first, max(idx) as last from i group by id, island""",
)
def split_islands(spark: SparkSession, folder: str) -> DataFrame:
    return series.segments(grid(spark, folder))


@query("gap_counts", f"""{GRID}, i as (select id, idx, idx - row_number() over (partition by id order by idx) as island from g),
r as (select id, count(*) as n from i group by id, island) select id, count(*) as segments, count(*) - 1 as gaps, max(n) as longest from r group by id""")
def gap_counts(spark: SparkSession, folder: str) -> DataFrame:
    return measure.gap_counts(grid(spark, folder))


@query("view_range", f"{GRID}, o as (select min(idx) as o from g) select {LISTED} from g where idx between 473353 and 473400")
def view_range(spark: SparkSession, folder: str) -> DataFrame:
    hour = tables.HOUR_US
    return plain(select.view(grid(spark, folder), 473353 * hour + hour // 3, 473400 * hour - hour // 4, 0, 1 / 3600))


@query("select_glob_and", f"{CODES} select network, station, channel, n from k where regexp_full_match(channel, 'EV[PS]') and regexp_full_match(station, 'U1.*')")
def select_glob_and(spark: SparkSession, folder: str) -> DataFrame:
    return select.select(series_codes(spark, folder), component="[PS]", station="U1*").select("network", "station", "channel", "n")


@query("select_glob_or", f"{CODES} select network, station, channel, n from k where regexp_full_match(channel, 'EV[^PS]') or regexp_full_match(station, 'U.')")
def select_glob_or(spark: SparkSession, folder: str) -> DataFrame:
    return select.select(series_codes(spark, folder), "union", component="[!PS]", station="U?").select("network", "station", "channel", "n")


@query("select_inverse", f"{CODES} select network, station, channel, n from k where not (channel = 'EVP' and regexp_full_match(station, '.*5'))")
def select_inverse(spark: SparkSession, folder: str) -> DataFrame:
    return select.select(series_codes(spark, folder), inverse=True, channel="EVP", station="*5").select("network", "station", "channel", "n")


@query("select_xor", f"{CODES} select network, station, channel, n from k where (channel = 'EVV') <> regexp_full_match(station, 'U[0-9][0-9]')")
def select_xor(spark: SparkSession, folder: str) -> DataFrame:
    return select.select(series_codes(spark, folder), "symmetric", channel="EVV", station="U[0-9][0-9]").select("network", "station", "channel", "n")


@query("select_stats", f"{CODES}, t as (select *, cast(n as integer) as npts from k) select station, channel, npts from t where npts = 12 or station = 'U7'")
def select_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = series_codes(spark, folder).withColumn("npts", F.col("n").cast("int"))
    return select.select(rows, "union", npts=12, station="U7").select("station", "channel", "npts")


@query("lookup_keys", f"{CODES} select network, station, channel, n from k where station || channel in ('U3EVP', 'U5EVC')")
def lookup_keys(spark: SparkSession, folder: str) -> DataFrame:
    return select.lookup(series_codes(spark, folder), "id", "EV.U3..EVP", "EV.U5..EVC").select("network", "station", "channel", "n")


@query("positions", f"{CODES}, r as (select *, row_number() over (order by station, channel) - 1 as p from k) select station, channel, n from r where p >= 3 and p < 40 and (p - 3) % 4 = 0")
def positions(spark: SparkSession, folder: str) -> DataFrame:
    return select.positions(series_codes(spark, folder), ["station", "channel"], 3, 40, 4).select("station", "channel", "n")


@query("split_on_counts", f"{CODES} select 'EV.' || station || '..EV' as part, count(*) as series, sum(n)::bigint as n from k group by station")
def split_on_counts(spark: SparkSession, folder: str) -> DataFrame:
    return select.split_on(series_codes(spark, folder), "instrument").groupBy("part").agg(F.count("*").alias("series"), F.sum("n").alias("n"))


@query(
    "id_keys",
    f"""{CODES} select network || '.' || station || '..' || channel as id, network || '.' || station || '..' || channel as nslc, station || '.' || network || '.' || channel || '.' as sncl,
network || '.' || station || '.' as site, network || '.' || station || '..' || left(channel, 2) as instrument, right(channel, 1) as component, '.' as modwt from k""",
)
def id_keys(spark: SparkSession, folder: str) -> DataFrame:
    keys = ids.id_keys()
    return series_codes(spark, folder).select(*[keys[k].alias(k) for k in ("id", "nslc", "sncl", "site", "instrument", "component", "modwt")])


@query("common_id", f"{CODES} select station, case when count(distinct network) = 1 then max(network) else '*' end as network, case when count(distinct channel) = 1 then max(channel) else '*' end as channel from k group by station")
def common_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = series_codes(spark, folder)
    return select.common_id(rows.withColumn("at", F.col("station")), ["at"]).select(F.col("at").alias("station"), "network", "channel")


@query("replace_rows", f"{GRID} select id, idx, round(case when component = 'P' then 0 else value end, 6) as value, fold from g")
def replace_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder)
    return plain(select.replaced(rows, rows.where("component = 'P'").withColumn("value", F.lit(0.0)), "id"))


@query("delete_rows", f"{GRID} select {LISTED} from g where component not in ('P', 'S')")
def delete_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder)
    return plain(select.without(rows, rows.where("component in ('P', 'S')"), "id"))


@query(
    "trim_pad_fill",
    f"""{GRID}, r as (select id, unnest(range(473300, 473401)) as idx from (select distinct id from g))
select r.id, r.idx, round(coalesce(g.value, -1), 6) as value, coalesce(g.fold, 0) as fold from r left join g on r.id = g.id and r.idx = g.idx""",
)
def trim_pad_fill(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.trim(grid(spark, folder).select("id", "idx", "value", "fold"), 473300, 473400, pad=True, fill=-1.0))


@query("normalize_max", f"{GRID} select id, idx, round(value / max(abs(value)) over (partition by id), 6) as value, fold from g")
def normalize_max(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.normalize(grid(spark, folder), "max"))


@query("normalize_std", f"{GRID} select id, idx, round(value / stddev_pop(value) over (partition by id), 6) as value, fold from g")
def normalize_std(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.normalize(grid(spark, folder), "std"))


@query("normalize_global", f"{GRID} select id, idx, round(value / (select max(abs(value)) from g), 6) as value, fold from g")
def normalize_global(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.normalize(grid(spark, folder), "max", "all"))


@query(
    "blind_edges",
    f"""{GRID}, r as (select *, min(idx) over (partition by id) as a, max(idx) over (partition by id) as b from g)
select id, idx, round(value, 6) as value, case when idx < a + 24 or idx > b - 12 then 0.0 else fold end::double as fold from r""",
)
def blind_edges(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.blind(grid(spark, folder), 24, 12))


@query(
    "taper_hann",
    f"""{GRID}, r as (select *, min(idx) over (partition by id) as a, max(idx) over (partition by id) as b from g),
m as (select *, floor(least(0.05::double * (b - a + 1), (b - a + 1) / 2)) as m from r),
w as (select *, case when idx - a < m then 0.5::double - 0.5::double * cos(pi() * (idx - a) / m) else 1 end * case when b - idx < m then 0.5::double - 0.5::double * cos(pi() * (b - idx) / m) else 1 end as w from m)
select id, idx, round(value * w, 6) as value, round(fold * w, 6) as fold from w""",
)
def taper_hann(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.taper(grid(spark, folder)))


@query("demean", f"{GRID} select id, idx, round(value - avg(value) over (partition by id), 6) as value, fold from g")
def demean(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.demean(grid(spark, folder)))


@query(
    "detrend_linear",
    f"""{GRID}, t as (select id, regr_slope(value, idx) as slope, avg(value) as level, avg(idx) as at from g group by id)
select g.id, g.idx, round(g.value - (t.level + t.slope * (g.idx - t.at)), 6) as value, g.fold from g join t on g.id = t.id""",
)
def detrend_linear(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.detrend(grid(spark, folder), "linear"))


@query(
    "detrend_simple",
    f"""{GRID}, t as (select id, arg_min(value, idx) as va, arg_max(value, idx) as vb, min(idx) as a, max(idx) as b from g group by id)
select g.id, g.idx, round(g.value - (va + (vb - va) / (b - a) * (g.idx - a)), 6) as value, g.fold from g join t on g.id = t.id""",
)
def detrend_simple(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.detrend(grid(spark, folder), "simple"))


@query(
    "differentiate",
    f"""{GRID}, n as (select *, case when lag(idx) over w = idx - 1 then lag(value) over w end as p, case when lead(idx) over w = idx + 1 then lead(value) over w end as q from g window w as (partition by id order by idx))
select id, idx, round(coalesce((q - p) / 2, q - value, value - p), 6) as value, fold from n""",
)
def differentiate(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.differentiate(grid(spark, folder)))


@query(
    "integrate",
    f"""{GRID}, n as (select *, coalesce(case when lag(idx) over w = idx - 1 then (value + lag(value) over w) / 2 end, 0) as step from g window w as (partition by id order by idx))
select id, idx, round(sum(step) over (partition by id order by idx rows unbounded preceding) + 0.0000314159::double, 4) as value, fold from n""",
)
def integrate(spark: SparkSession, folder: str) -> DataFrame:
    return series.integrate(grid(spark, folder), length=256).select("id", "idx", F.round(F.col("value") + OFF_TIES, 4).alias("value"), "fold")


@query("decimate_nofilter", f"""{GRID}, r as (select *, min(idx) over (partition by id) as a from g)
select id, a // 4 + (idx - a) // 4 as idx, round(value, 6) as value, fold from r where (idx - a) % 4 = 0""")
def decimate_nofilter(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.decimate(grid(spark, folder), 4))


def _fine(value: str) -> str:
    return f"""{GRID}, n as (select *, lead(idx) over w as idx2, lead(value) over w as value2, lead(fold) over w as fold2 from g window w as (partition by id order by idx)),
f as (select *, unnest(case when idx2 = idx + 1 then range(4) else [0] end) as k from n)
select id, idx * 4 + k as idx, round({value} + 0.0000314159::double, 6) as value, round(case when k = 0 then fold else fold + (fold2 - fold) * (k / 4) end, 6) as fold from f"""


@query("interp_linear", _fine("case when k = 0 then value else value + (value2 - value) * (k / 4) end"))
def interp_linear(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.interpolate(grid(spark, folder), 4).withColumn("value", F.col("value") + OFF_TIES))


@query("interp_nearest", _fine("case when k <= 2 then value else value2 end"))
def interp_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.interpolate(grid(spark, folder), 4, "nearest").withColumn("value", F.col("value") + OFF_TIES))


@query("interp_zero", _fine("value"))
def interp_zero(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.interpolate(grid(spark, folder), 4, "zero").withColumn("value", F.col("value") + OFF_TIES))


@query(
    "sta_lta_classic",
    f"""{GRID}, n as (select *, avg(value * value) over (partition by id order by idx range between 2 preceding and current row) as sta, avg(value * value) over (partition by id order by idx range between 11 preceding and current row) as lta,
lag(idx, 11) over (partition by id order by idx) as back from g)
select id, idx, round(case when back = idx - 11 and lta > 0 then sta / lta else 0 end, 6) as value, fold from n""",
)
def sta_lta_classic(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.sta_lta(grid(spark, folder), 3, 12, length=256))


@query(
    "zdetect",
    f"""{GRID}, n as (select *, avg(value * value) over (partition by id order by idx range between 5 preceding and current row) as sta from g)
select id, idx, round((sta - avg(sta) over (partition by id)) / stddev_pop(sta) over (partition by id), 6) as value, fold from n""",
)
def zdetect(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.z_detect(grid(spark, folder), 6))


@query("make_gappy", f"""{GRID}, r as (select *, idx - min(idx) over (partition by id) as i, max(idx) over (partition by id) - min(idx) over (partition by id) + 1 as n from g)
select id, idx, round(case when i >= round_even(n * 0.25::double, 0) and i < round_even(n * 0.5::double, 0) then null else value end, 6) as value, case when i >= round_even(n * 0.25::double, 0) and i < round_even(n * 0.5::double, 0) then 0.0 else fold end::double as fold from r""")
def make_gappy(spark: SparkSession, folder: str) -> DataFrame:
    return plain(series.make_gappy(grid(spark, folder)))


@query("align_start", """with s as (select o_orderpriority as id, min(epoch_us(o_orderdate)) + 7200000123 * count(*) as start_us from orders group by 1), p as (select *, start_us * (1::double / 3600) / 1000000 as place from s)
select id, start_us, cast(round_even(case when abs(place - round_even(place, 0)) <= 0.01 then round_even(place, 0) else ceil(place) end * 1000000 / (1::double / 3600), 0) as bigint) as aligned_us, not (abs(place - round_even(place, 0)) <= 0.01) as resampled from p""")
def align_start(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.table(spark, folder, "orders")
    starts = orders.groupBy(F.col("o_orderpriority").alias("id")).agg((F.min(tables.micros(F.col("o_orderdate"))) + 7200000123 * F.count("*")).alias("start_us"))
    return series.align_start(starts, 1 / 3600)


@query("valid_fraction", f"{GRID} select id, round(count(*) filter (where fold >= 2) / 100::double, 6) as valid_fraction from g where idx between 473301 and 473400 group by id")
def valid_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return measure.valid_fraction(grid(spark, folder), 473301, 473400, 2.0).withColumn("valid_fraction", F.round("valid_fraction", 6))


@query("trace_summary", f"{GRID} select id, count(*) as npts, count(*) filter (where value is null) as masked, round(greatest(abs(max(value)), abs(min(value))), 6) as abs_max, round(stddev_pop(value), 6) as std, round(avg(fold), 6) as fold_mean from g group by id")
def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = measure.summary(grid(spark, folder))
    return found.select("id", "npts", "masked", *[F.round(c, 6).alias(c) for c in ("abs_max", "std", "fold_mean")])


@query("fold_hist", f"{GRID} select id, cast(ceil(fold) as bigint) as fold, count(*) as n from g group by all")
def fold_hist(spark: SparkSession, folder: str) -> DataFrame:
    return measure.fold_counts(grid(spark, folder))


@query("first_maximum", f"{GRID} select id, round(max(value), 6) as p_max, min(idx) as idx from g where value = (select max(value) from g h where h.id = g.id) group by id")
def first_maximum(spark: SparkSession, folder: str) -> DataFrame:
    return measure.first_maximum(grid(spark, folder)).withColumn("p_max", F.round("p_max", 6))


@query(
    "weighted_moments",
    f"""{GRID}, x as (select id, cast(idx - min(idx) over (partition by id) as double) as x, min(idx) over (partition by id) as o, value as y from g),
m as (select id, any_value(o) as o, sum(y * x) / sum(y) as mean, sum(y) as w, count(*) filter (where y <> 0) as k from x group by id),
d as (select x.id, any_value(m.o) + any_value(m.mean) as mean, sqrt(sum(y * (x - m.mean) ** 2) / (any_value(m.w) * (any_value(m.k) - 1) / any_value(m.k))) as std, sum(y * (x - m.mean) ** 3) / any_value(m.w) as c3, sum(y * (x - m.mean) ** 4) / any_value(m.w) as c4 from x join m on x.id = m.id group by x.id)
select id, round(mean, 4) as mean, round(std, 4) as std, round(c3 / std ** 3, 4) as skewness, round(c4 / std ** 4, 4) as kurtosis from d""",
)
def weighted_moments(spark: SparkSession, folder: str) -> DataFrame:
    found = measure.weighed_moments(grid(spark, folder))
    return found.select("id", *[F.round(c, 4).alias(c) for c in ("mean", "std", "skewness", "kurtosis")])


@query(
    "cdf_quantiles",
    f"""{GRID}, c as (select id, idx, sum(value) over (partition by id order by idx rows unbounded preceding) / sum(value) over (partition by id) as share from g),
d as (select id, q, idx, round(abs(q - share), 12) as d from c, (select unnest([0.16::double, 0.5::double, 0.84::double]) as q))
select id, q, min(idx) as idx from d where d = (select min(d) from d e where e.id = d.id and e.q = d.q) group by id, q""",
)
def cdf_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return measure.quantile_indices(grid(spark, folder), length=256)


@query("line_misfit", f"""{GRID}, t as (select id, regr_slope(value, idx) as slope, avg(value) as level, avg(idx) as at from g group by id),
r as (select g.id, g.value, g.value - (t.level + t.slope * (g.idx - t.at)) as rest from g join t on g.id = t.id)
select id, round(sum(abs(rest)), 4) as l1, round(sqrt(sum(rest * rest)), 4) as l2, round(1 - sum(rest * rest) / (var_pop(value) * count(*)), 6) as r_squared from r group by id""")
def line_misfit(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder)
    rest = series.detrend(rows, "linear").select("id", "idx", F.col("value").alias("rest"))
    both = rows.join(rest, ["id", "idx"])
    found = measure.misfit(both, F.col("value"), F.col("value") - F.col("rest"))
    return found.select("id", F.round("l1", 4).alias("l1"), F.round("l2", 4).alias("l2"), F.round("r_squared", 6).alias("r_squared"))


#: windows of 24 samples every 12, anchored per component, in SQL
WINDOWS = f"""{GRID}, a as (select id, min(idx) as a, max(idx) as b from g group by id),
w as (select a.id, unnest(range((b - a) // 12 + 1)) as k from a), v as (select w.id, w.k, any_value(a.a) + w.k * 12 as first, any_value(a.b) as b, count(g.idx) filter (where g.fold >= 1) / 24::double as vf
from w join a on w.id = a.id left join g on g.id = w.id and g.idx between a.a + w.k * 12 and a.a + w.k * 12 + 23 group by w.id, w.k)"""


@query("windows_normal", f"{WINDOWS} select id, k, first, first + 23 as last, round(vf, 6) as valid_fraction from v where vf >= 0.2 and b - 2 > first + 23")
def windows_normal(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder).withColumn("series", F.col("id"))
    found = windows.ready(rows, ["id"], "series", F.lit(True), 24, 12, min_valid=0.2, delay=2)
    return found.withColumn("valid_fraction", F.round("valid_fraction", 6))


@query("windows_eager", f"{WINDOWS} select id, k, first, first + 23 as last, round(vf, 6) as valid_fraction from v where vf >= 0.2")
def windows_eager(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder).withColumn("series", F.col("id"))
    return windows.ready(rows, ["id"], "series", F.lit(True), 24, 12, min_valid=0.2, eager=True).withColumn("valid_fraction", F.round("valid_fraction", 6))


@query("windows_owned", f"{GRID}, a as (select id, min(idx) as a from g group by id) select g.id, g.idx, greatest(0, (g.idx - a.a - 24) // 12 + 1 - case when (g.idx - a.a - 24) % 12 <> 0 and g.idx - a.a < 24 then 1 else 0 end) as k from g join a on g.id = a.id")
def windows_owned(spark: SparkSession, folder: str) -> DataFrame:
    return windows.owned(grid(spark, folder).select("id", "idx"), ["id"], F.lit(True), 24, 12)


PIVOT = ", ".join(f"round(max(value) filter (where component = '{c}'), 6) as value_{c}, max(fold) filter (where component = '{c}') as fold_{c}" for c in "PCS")


@query("window_collate", f"{GRID} select instrument, idx, {PIVOT} from g where component in ('P', 'C', 'S') group by instrument, idx")
def window_collate(spark: SparkSession, folder: str) -> DataFrame:
    found = collate.collate(grid(spark, folder).where("component in ('P', 'C', 'S')"), "PCS")
    return found.select("instrument", "idx", *[x for c in "PCS" for x in (F.round(f"value_{c}", 6).alias(f"value_{c}"), f"fold_{c}")])


def instrument_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 24 samples every 24 of the one instrument, anchored at component P, of the components P, C and S."""
    rows = grid(spark, folder).where("component in ('P', 'C', 'S')").drop("id")
    return windows.placed(rows, ["instrument"], F.col("component") == "P", 24, 24)


#: the same windows in SQL, and which components pass 0.5 (P) and 0.95 (others)
FILL = f"""{GRID}, o as (select min(idx) as a from g where component = 'P'), s as (select instrument, component, (idx - a) // 24 as k, idx, value, fold from g, o where idx >= a and component in ('P', 'C', 'S')),
p as (select instrument, k, component, count(*) filter (where fold >= 1) / 24::double + 0.001::double >= case when component = 'P' then 0.5 else 0.95 end as ok from s group by instrument, k, component),
ok as (select instrument, k, list(component) filter (where ok) as good from p group by instrument, k having list_contains(list(component) filter (where ok), 'P')),
plan as (select instrument, k, c as component, list_contains(good, c) as kept, good from ok, (select unnest(['P', 'C', 'S']) as c))"""
SHARES = {"primary_share": 0.5, "secondary_share": 0.95}


def _filled(donor: str) -> str:
    return f"""{FILL} select plan.instrument, plan.k, plan.component, s.idx, round(case when {donor} is null and not kept then 0 else s.value end, 6) as value, case when kept then s.fold else 0.0 end::double as fold
from plan join s on s.instrument = plan.instrument and s.k = plan.k and s.component = case when kept then plan.component else coalesce({donor}, 'P') end"""


@query("fill_zeros", _filled("null::varchar"))
def fill_zeros(spark: SparkSession, folder: str) -> DataFrame:
    return collate.fill_components(instrument_windows(spark, folder), 24, "PCS", "zeros", **SHARES).withColumn("value", F.round("value", 6))


@query("fill_primary", _filled("'P'"))
def fill_primary(spark: SparkSession, folder: str) -> DataFrame:
    return collate.fill_components(instrument_windows(spark, folder), 24, "PCS", "primary", **SHARES).withColumn("value", F.round("value", 6))


@query("fill_secondary", _filled("case when list_contains(good, 'C') then 'C' when list_contains(good, 'S') then 'S' else 'P' end"))
def fill_secondary(spark: SparkSession, folder: str) -> DataFrame:
    return collate.fill_components(instrument_windows(spark, folder), 24, "PCS", "secondary", **SHARES).withColumn("value", F.round("value", 6))


@query("window_validity", f"""{FILL} select instrument, k, component, round(count(*) filter (where fold >= 1) / 24::double, 6) as valid_fraction, count(*) filter (where fold >= 1) / 24::double + 0.001::double >= case when component = 'P' then 0.5 else 0.95 end as passes from s group by instrument, k, component""")
def window_validity(spark: SparkSession, folder: str) -> DataFrame:
    return collate.validity(instrument_windows(spark, folder), 24, "P", **SHARES).withColumn("valid_fraction", F.round("valid_fraction", 6))


@query("collapse_fold", f"{GRID} select instrument, idx, sum(fold) as fold from g group by instrument, idx")
def collapse_fold(spark: SparkSession, folder: str) -> DataFrame:
    return measure.collapse_fold(grid(spark, folder), ["instrument"])


@query("tensor_rows", f"""{FILL}, t as (select instrument, k, component, count(*) as n, sum(value) as total from s group by all),
u as (select instrument, k, count(*) as c, sum(total) as total from t where n = 24 group by all) select instrument, k, 3 as components, 24 as npts, round(total, 1) as total from u where c = 3""")
def tensor_rows(spark: SparkSession, folder: str) -> DataFrame:
    made = collate.tensor(instrument_windows(spark, folder), "PCS", 24)
    total = F.aggregate(F.flatten("tensor"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return made.select("instrument", "k", F.size("tensor").alias("components"), F.size(F.col("tensor")[0]).alias("npts"), F.round(total, 1).alias("total"))


@query("item_grid", """select 'LI.' || l_returnflag || '.' || l_linestatus as id, epoch_us(l_shipdate) // 86400000000 as idx, round(avg(l_extendedprice), 6) as value, cast(count(*) as double) as fold from lineitem where l_extendedprice is not null group by all""")
def item_grid(spark: SparkSession, folder: str) -> DataFrame:
    return plain(tables.item_samples(spark, folder))


@query("inventory_match", f"{CODES} select network, station, channel, n from k where station in (select 'U' || cast(c_custkey % 40 as varchar) from customer) and n > 2")
def inventory_match(spark: SparkSession, folder: str) -> DataFrame:
    stations = tables.table(spark, folder, "customer").select(F.concat(F.lit("U"), (F.col("c_custkey") % 40).cast("string")).alias("station"))
    return select.in_inventory(series_codes(spark, folder), stations, "station").where("n > 2").select("network", "station", "channel", "n")


@query("id_sets", """with a as (select distinct event_type as id from events), b as (select distinct o_orderpriority as id from orders union all select 'click' as id)
select 'union' as how, id from (select id from a union select id from b) union all select 'intersection', id from (select id from a intersect select id from b) union all select 'difference', id from (select id from a except select id from b)""")
def id_sets(spark: SparkSession, folder: str) -> DataFrame:
    a = tables.table(spark, folder, "events").select(F.col("event_type").alias("id"))
    b = tables.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("id")).union(spark.createDataFrame([("click",)], "id string"))
    made = [select.id_set(a, b, how).select(F.lit(how).alias("how"), "id") for how in ("union", "intersection", "difference")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("remove_sensitivity", f"{GRID} select id, idx, round(value / case component when 'P' then 4 when 'C' then 5 else 1 end, 6) as value, fold from g")
def remove_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    gains = spark.createDataFrame([("EV.ALL..EVP", 4.0), ("EV.ALL..EVC", 5.0), ("EV.ALL..EVS", 0.0)], "id string, gain double")
    return plain(series.remove_sensitivity(grid(spark, folder), gains))


@query(
    "windows_padded",
    f"""{WINDOWS}, r as (select id, k, first from v where vf >= 0.2), p as (select id, k, unnest(range(first, first + 24)) as idx from r)
select p.id, p.k, p.idx, round(g.value, 6) as value, coalesce(g.fold, 0) as fold from p left join g on p.id = g.id and p.idx = g.idx""",
)
def windows_padded(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder).select("id", "idx", "value", "fold")
    found = windows.ready(rows.withColumn("series", F.col("id")), ["id"], "series", F.lit(True), 24, 12, min_valid=0.2, eager=True)
    return windows.padded(rows, ["id"], found.select("id", "k", "first"), 24).select("id", "k", "idx", F.round("value", 6).alias("value"), "fold")


@query("window_targets", f"{FILL}, w as (select instrument, k, min(idx) as start_us, count(distinct idx) as npts from s group by all) select instrument, k, start_us % 24 = 1 as start_ok, true as rate_ok, npts = 24 as npts_ok from w")
def window_targets(spark: SparkSession, folder: str) -> DataFrame:
    per = instrument_windows(spark, folder).groupBy("instrument", "k").agg(F.min("idx").alias("start_us"), F.count_distinct("idx").alias("npts"))
    wanted = F.col("start_us") - F.col("start_us") % 24 + 1
    return collate.target_checks(per.withColumn("sampling_rate", F.lit(1.0)), wanted, 1.0, 24).select("instrument", "k", "start_ok", "rate_ok", "npts_ok")


@query("window_header", f"{GRID}, c as (select instrument, component, min(idx) as a from g where component in ('S', 'P') group by all) select instrument, arg_min(component, (a, component)) as primary, min(a) as start from c group by instrument")
def window_header(spark: SparkSession, folder: str) -> DataFrame:
    return collate.header(grid(spark, folder), ["S", "P"])
