"""Queries whose work is signal processing, fitting or scoring in Python, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.operators import collate, dsp, predict, series, trigger, windows
from foldloom.operators.frames import in_spans
from foldloom.plans.catalog import query
from foldloom.plans.pipeline import picking, preprocessing
from foldloom.plans.series_queries import GRID, OFF_TIES, SHARES, grid, instrument_windows
from foldloom.sources.packets import to_packets, to_samples, unmasked


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return grid(spark, folder).select("id", "idx", "value", "fold")


def _filtered(sections: list[list[float]]) -> str:
    """The filter over each contiguous piece of table d (id, island, j, idx, value, fold) in SQL: u, of which `y` is the result."""
    states = [f"{z}{k}" for k in range(len(sections)) for z in "pq"]
    held = []
    # each level of the nest works out one section from the one before it
    nest = "select {keys}, d.value as x, {before} from {source}"
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        nest = f"select *, {b0!r}::double * {'x' if k == 0 else f'y{k - 1}'} + p{k} as y{k} from ({nest})"
        held += [f"{b1!r}::double * {'x' if k == 0 else f'y{k - 1}'} - ({a1!r}::double) * y{k} + q{k}", f"{b2!r}::double * {'x' if k == 0 else f'y{k - 1}'} - ({a2!r}::double) * y{k}"]
    last = f"y{len(sections) - 1}"
    new = lambda keys, before, source: f"select id, island, j, idx, fold, {last} as y, {', '.join(f'{h} as n_{s}' for h, s in zip(held, states, strict=True))} from ({nest.format(keys=keys, before=before, source=source)})"
    keys = "d.id, d.island, d.j, d.idx, d.fold"
    first = new(keys, ", ".join(f"0::double as {s}" for s in states), "d where d.j = 1")
    following = new(keys, ", ".join(f"u.n_{s} as {s}" for s in states), "u join d on d.id = u.id and d.island = u.island and d.j = u.j + 1")
    return f"u as ({first} union all {following})"


BAND, STOPPED = (1 / 48, 1 / 4, 1.0), (1 / 12, 1 / 6, 1.0)
#: fixed values for the SQL, not worked out by the library: sections of both filters from the Butterworth polynomial of order four (1, 2.6131259, 3.4142136,
#: 2.6131259, 1) by Constantinides' transformations, (1 - 2 c / z + 1 / z^2) / (k (1 - 1 / z^2)) in place of s for the band-pass and its reciprocal for the band-stop,
#: factored; b0, b1, b2, a1, a2
PASS_SECTIONS = [
    [0.517121333587849, 0.0, -0.517121333587849, -0.023091627940168155, 0.49238192337800746],
    [0.517121333587849, 0.0, -0.517121333587849, -0.12579063546273095, 0.057189734739424694],
    [0.517121333587849, 0.0, -0.517121333587849, -1.7476506571626746, 0.7668267998011602],
    [0.517121333587849, 0.0, -0.517121333587849, -1.8968285420138506, 0.9137129645774507],
]
STOP_SECTIONS = [
    [0.8408186205185701, -1.2310439003391374, 0.8408186205185701, -0.9246211099724259, 0.7843620196495644],
    [0.8408186205185701, -1.2310439003391374, 0.8408186205185701, -1.0186463504443757, 0.5709605475805802],
    [0.8408186205185701, -1.2310439003391374, 0.8408186205185701, -1.3127613067740516, 0.6446074435529373],
    [0.8408186205185701, -1.2310439003391374, 0.8408186205185701, -1.6037840338738936, 0.8653905218552552],
]
CENTRED = f"""{GRID.replace("with g", "with recursive g")}, i as (select id, idx, value - avg(value) over (partition by id) as value, fold, idx - row_number() over (partition by id order by idx) as island from g),
d as (select *, row_number() over (partition by id, island order by idx) as j from i)"""


@query("bandpass", f"{CENTRED}, {_filtered(PASS_SECTIONS)} select id, idx, round(y + 0.0000314159::double, 5) as value, fold from u")
def bandpass(spark: SparkSession, folder: str) -> DataFrame:
    """Periods of 4 to 48 hours."""
    found = dsp.bandpass(series.demean(samples(spark, folder)), *BAND)
    return found.select("id", "idx", F.round(F.col("value") + OFF_TIES, 5).alias("value"), "fold")


@query("bandstop", f"{CENTRED}, {_filtered(STOP_SECTIONS)} select id, idx, round(y + 0.0000314159::double, 5) as value, fold from u")
def bandstop(spark: SparkSession, folder: str) -> DataFrame:
    """Without periods of 6 to 12 hours."""
    found = dsp.bandpass(series.demean(samples(spark, folder)), *STOPPED, stop=True)
    return found.select("id", "idx", F.round(F.col("value") + OFF_TIES, 5).alias("value"), "fold")


@query(
    "fft_resample",
    f"""{GRID}, i as (select id, idx, value, fold, idx // 48 as cut, idx - row_number() over (partition by id order by idx) as island from g), p as (select id, cut, island, min(idx) as a, count(*) as n from i group by all),
m as (select *, unnest(range(2 * n - 1)) as m from p), k as (select m.id, m.a, m.n, m.m, i.idx - m.a as j, i.value, i.fold, (m.m / 2::double - (i.idx - m.a)) as t from m join i on i.id = m.id and i.cut = m.cut and i.island = m.island)
select id, 2 * a + m as idx, round(sum(value * case when t = 0 then 1 when m % 2 = 0 then 0 when n % 2 = 0 then sin(pi() * t) / (n * tan(pi() * t / n)) else sin(pi() * t) / (n * sin(pi() * t / n)) end) + 0.0000314159::double, 5) as value,
round(sum(case when abs(t) < 1 then (1 - abs(t)) * fold else 0 end), 6) as fold from k group by id, a, m""",
)
def fft_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of 48 hours at twice the rate, each split at its gaps; a piece of one sample stays as it is."""
    packets = unmasked(to_packets(samples(spark, folder), 48, "id"), "id")
    found = to_samples(dsp.resample(packets, 2.0, "id"), "id")
    return found.select("id", "idx", F.round(F.col("value") + OFF_TIES, 5).alias("value"), F.round("fold", 6).alias("fold"))


@query(
    "lsq_optimal",
    f"""{GRID}, b as (select id, idx, idx - row_number() over (partition by id order by idx) as island, value from g where value > 20), t as (select id, min(idx) filter (where value > 40) as on_, max(idx) as off_ from b group by id, island having max(value) > 40)
select t.id, t.on_ as "on", count(*) as n, 0.0::double as height_slope, 0.0::double as mean_slope, 0.0::double as std_slope from t join g on g.id = t.id and g.idx between t.on_ - 2 and t.off_ + 2 group by all having count(*) >= 4""",
)
def lsq_optimal(spark: SparkSession, folder: str) -> DataFrame:
    """The normal equations of the fitted gaussians at their solution: slopes of the squared rest in height, mean and standard deviation, as cosines, are 0."""
    fits = lsq_gaussian(spark, folder)
    rows = samples(spark, folder)
    found = trigger.onsets(rows, 40.0, 20.0)
    inside = in_spans(rows, found.select("id", (F.col("on") - 2).alias("first"), (F.col("off") + 2).alias("last"), "on"), ["id"]).join(fits, ["id", "on"])
    u = (F.col("idx") - F.col("mean")) / F.col("std")
    e = F.exp(-u * u / 2)
    rest = F.col("value") - F.col("height") * e
    slopes = {"height_slope": e, "mean_slope": e * u, "std_slope": e * u * u}
    # a fit that runs away past the samples has its least only in the limit, and counts as 0
    within = F.max("mean").between(F.min("idx"), F.max("idx"))
    cosine = lambda s: F.when(within, F.round(F.abs(F.coalesce(F.try_divide(F.sum(rest * s), F.sqrt(F.sum(rest * rest) * F.sum(s * s))), F.lit(0.0))), 2)).otherwise(0.0)
    return inside.groupBy("id", "on").agg(F.count("*").alias("n"), *[cosine(s).alias(name) for name, s in slopes.items()])


@query("lsq_gaussian")
def lsq_gaussian(spark: SparkSession, folder: str) -> DataFrame:
    """A gaussian for each trigger, over two samples more on both sides."""
    rows = samples(spark, folder)
    found = trigger.onsets(rows, 40.0, 20.0)
    spans = found.select("id", (F.col("on") - 2).alias("first"), (F.col("off") + 2).alias("last"), "on")
    return dsp.gaussian_fits(in_spans(rows, spans, ["id"]))


def _scores(step: int, shares: tuple[float, float], weights: dict[str, tuple[int, int]]) -> str:
    """Windows of 24 samples every `step` of the components P, C and S in SQL, repaired by the first good secondary and scored.

    y: instrument, k, pos, weight, p and s (scores of the labels P and S); c: instrument, k, pos, fold summed over components.
    """
    frame = lambda n: f"avg(x * x) over (partition by instrument, k, component order by pos rows between {n - 1} preceding and current row)"
    rated = " union all ".join(f"select *, '{w}' as weight, {frame(a)} / ({frame(b)} + 1e-12::double) as r from t" for w, (a, b) in weights.items())
    return f"""{GRID}, o as (select min(idx) as a from g where component = 'P'), q as (select instrument, component, idx, value, fold, idx - a as at_ from g, o where idx >= a and component in ('P', 'C', 'S')),
s as (select *, unnest(range(greatest(0, cast(floor((at_ - 24) / {step}::double) as bigint) + 1), at_ // {step} + 1)) as k from q), e as (select instrument, k, component, count(*) filter (where fold >= 1) / 24::double + 0.001::double >= case when component = 'P' then {shares[0]} else {shares[1]} end as ok from s group by instrument, k, component),
h as (select instrument, k, list(component) filter (where ok) as good from e group by instrument, k having list_contains(list(component) filter (where ok), 'P')),
plan as (select instrument, k, c as component, list_contains(good, c) as kept, case when list_contains(good, c) then c when list_contains(good, 'C') then 'C' when list_contains(good, 'S') then 'S' else 'P' end as donor from h, (select unnest(['P', 'C', 'S']) as c)),
t as (select plan.instrument, plan.k, plan.component, pos, cast(cast(coalesce(s.value, 0) as float) as double) as x, case when kept then coalesce(s.fold, 0) else 0 end as fold from plan cross join (select unnest(range(24)) as pos) cross join o
left join s on s.instrument = plan.instrument and s.k = plan.k and s.component = plan.donor and s.idx = o.a + plan.k * {step} + pos),
n as ({rated}), y as (select instrument, k, pos, weight, max(r / (1 + r)) filter (where component = 'P') as p, avg(r / (1 + r)) filter (where component <> 'P') as s from n group by all), c as (select instrument, k, pos, sum(fold) as fold from t group by all)"""


@query(
    "predict_multiweight",
    f"""{_scores(24, (0.5, 0.95), {"fast": (2, 8), "slow": (4, 12)})} select instrument, k, weight, pos, 'Detection' as label, round(greatest(p, s), 6) as value from y
union all select instrument, k, weight, pos, 'P', round(p, 6) from y union all select instrument, k, weight, pos, 'S', round(s, 6) from y""",
)
def predict_multiweight(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every window, weight and label, sample by sample."""
    placed = instrument_windows(spark, folder)
    filled = collate.whole(collate.fill_components(placed, 24, "PCS", "secondary", **SHARES), windows.spans(placed, ["instrument"], 24, 24))
    tensors = collate.tensor(filled, "PCS", 24)
    made = predict.predict(tensors, {"fast": predict.energy_ratio(2, 8), "slow": predict.energy_ratio(4, 12)}, ("Detection", "P", "S"), "ER")
    each = made.select("instrument", "k", "weight", "label", F.posexplode("values").alias("pos", "value"))
    return each.select("instrument", "k", "weight", F.col("pos").cast("long").alias("pos"), "label", F.round("value", 6).alias("value"))


@query(
    "preprocess_window",
    f"""{GRID.replace("with g", "with recursive g")}, l as (select id, regr_slope(value, idx) as slope, avg(value) as level, avg(idx) as mid, min(idx) as a, max(idx) as b from g group by id),
i as (select g.id, g.idx, g.value - (l.level + l.slope * (g.idx - l.mid)) as value, g.fold, g.idx - row_number() over (partition by g.id order by g.idx) as island from g join l on l.id = g.id),
d as (select *, row_number() over (partition by id, island order by idx) as j from i), {_filtered(PASS_SECTIONS)},
m as (select u.*, l.a, l.b, floor(least(0.05::double * (l.b - l.a + 1), (l.b - l.a + 1) / 2)) as m from u join l on l.id = u.id),
w as (select *, case when idx - a < m then 0.5::double - 0.5::double * cos(pi() * (idx - a) / m) else 1 end * case when b - idx < m then 0.5::double - 0.5::double * cos(pi() * (b - idx) / m) else 1 end as w from m),
n as (select id, idx, y * w / stddev_pop(y * w) over (partition by id) as value, fold * w as fold from w), r as (select id, unnest(range(a, b + 1)) as idx from l)
select r.id, r.idx, round(n.value + 0.0000314159::double, 5) as value, coalesce(round(n.fold, 5), 0) as fold from r left join n on n.id = r.id and n.idx = r.idx""",
)
def preprocess_window(spark: SparkSession, folder: str) -> DataFrame:
    """Detrend, filter, taper and normalise each contiguous series, then put it on its grid with gaps masked."""
    made = preprocessing(1.0, 1 / 48, 1 / 4).run(samples(spark, folder))
    return made.select("id", "idx", F.round(F.col("value") + OFF_TIES, 5).alias("value"), F.round("fold", 5).alias("fold"))


_QUALITY = "case when p_max > 0.9 then 0 when p_max > 0.7 then 1 when p_max > 0.5 then 2 when p_max > 0.3 then 3 else 4 end"


@query(
    "picking_pipeline",
    f"""{_scores(12, (0.9, 0.8), {"fast": (2, 8)})}, l as (select y.instrument || l || '.ER.fast' as id, o.a + y.k * 12 + y.pos as idx, case l when 'P' then p else s end as value, c.fold
from y join c on c.instrument = y.instrument and c.k = y.k and c.pos = y.pos cross join o cross join (select unnest(['P', 'S']) as l) where y.pos between 2 and 21 and c.fold > 0),
z as (select id, idx, case when count(*) = 1 then max(value) else sum(value * fold) / sum(fold) end as value, sum(fold) as fold from l group by id, idx),
b as (select id, idx, idx - row_number() over (partition by id order by idx) as island, value from z where value > 0.3), i as (select id, min(idx) filter (where value > 0.5) as on_, max(idx) as off_ from b group by id, island having max(value) > 0.5),
u as (select i.id, on_, off_, count(*) as npts, max(z.value) as p_max, arg_max(z.idx, (z.value, -z.idx)) as at_max, avg(z.fold) as fold_mean from i join z on z.id = i.id and z.idx between on_ and off_ group by all)
select id, on_ as "on", off_ as "off", npts, round(p_max, 6) as p_max, at_max, round(fold_mean, 6) as fold_mean, at_max * 3600000000 as pick_us, (at_max - on_) * 3600::double as lower, (off_ - at_max) * 3600::double as upper, round((1 - 0.5::double / p_max) * 100, 4) as confidence, {_QUALITY} as quality from u""",
)
def picking_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The whole path from events to picks: window, repair, predict, blind, stack, trigger, pick."""
    rows = grid(spark, folder).where("component in ('P', 'C', 'S')").drop("id")
    found = picking(rows, "PCS", length=24, step=12, blinding=2, thr_on=0.5, thr_off=0.3)
    rounded = {c: F.round(c, n) for c, n in (("p_max", 6), ("fold_mean", 6), ("confidence", 4))}
    return found.select("id", "on", "off", "npts", "at_max", "pick_us", "lower", "upper", "quality", *[v.alias(c) for c, v in rounded.items()])
