"""Threshold excursions: triggers, their summaries, and picks.

A trigger is a run of consecutive samples above thr_off that holds a sample above thr_on; it begins at the first such
sample and ends with the run. A run still open at the end of the data counts. Longer than max_len samples, it is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import shapes
from foldloom.operators import measure, pairs
from foldloom.operators.frames import LENGTH, chunk, in_runs

BY = ("id",)


def _excursions(samples: DataFrame, thr_on: float, thr_off: float, by: Sequence[str], length: int) -> DataFrame:
    """by, on, off, npts, top (value, -idx), fold_mean, low_ of every trigger; low_ is the lowest fold before off.

    Only samples above thr_off matter. They are placed by (by, chunk) once; there a run is what has equal differences of number and rank, and sums up to one row: over all
    of it, and from its first sample above thr_on. Runs that touch neither edge of their chunk are triggers as they are; the others, at most two a chunk,
    are joined to chains, in which a trigger begins with the first part that has a sample above thr_on.
    """
    if thr_off > thr_on:
        raise ValueError("thr_off must not exceed thr_on")
    held = samples.where(F.col("value") > thr_off).select(*by, "idx", "value", "fold", chunk(length).alias("chunk_"))
    ranked = held.withColumn("run_", F.col("idx") - F.row_number().over(Window.partitionBy(*by, "chunk_").orderBy("idx")))
    whole = Window.partitionBy(*by, "chunk_", "run_")
    placed = ranked.withColumns({"on_": F.min(F.when(F.col("value") > thr_on, F.col("idx"))).over(whole), "last_": F.max("idx").over(whole)})
    since, body = F.col("idx") >= F.col("on_"), F.col("idx") < F.col("last_")
    top = F.struct(F.col("value").alias("value"), (-F.col("idx")).alias("back"))
    told = {"n": (F.count, F.lit(1)), "top": (F.max, top), "f": (F.sum, F.col("fold")), "c": (F.count, F.col("fold"))}
    sums = [made(F.when(since, what) if part else what).alias(f"{name}{part}") for name, (made, what) in told.items() for part in ("", "_on")]
    low = [F.min(F.when(body & since if part else body, F.col("fold"))).alias(f"low{part}") for part in ("", "_on")]
    runs = placed.groupBy(*by, "chunk_", "run_").agg(F.min("idx").alias("first"), F.max("idx").alias("off"), F.min("on_").alias("on"), F.max(F.when(~body, F.col("fold"))).alias("end"), *sums, *low)
    # never null, so that nothing is inferred of it and both uses of runs share the one exchange of samples
    edge = F.coalesce((F.col("first") == F.col("chunk_") * length) | (F.col("off") == F.col("chunk_") * length + length - 1), F.lit(True))
    mean = lambda f, c: F.when(F.col(c) > 0, F.col(f) / F.col(c))
    alone = runs.where(~edge & F.col("on").isNotNull()).select(*by, "on", "off", F.col("n_on").alias("npts"), F.col("top_on").alias("top"), mean("f_on", "c_on").alias("fold_mean"), F.col("low_on").alias("low_"))
    # edges: a chain goes on where the next part begins right after
    order = Window.partitionBy(*by).orderBy("first")
    linked = runs.where(edge).withColumn("new_", F.coalesce(F.col("first") != F.lag("off").over(order) + 1, F.lit(True)).cast("int"))
    chained = linked.withColumn("chain_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(*by, "chain_")
    marked = chained.withColumns({"start_": F.min(F.when(F.col("on").isNotNull(), F.col("first"))).over(chain), "final_": F.max("off").over(chain)})
    begins = F.col("first") == F.col("start_")
    pick = lambda name: F.when(begins, F.col(f"{name}_on")).otherwise(F.col(name))
    # within a chain, the last sample of a part counts as one before off, but for that of the last part
    inner = F.least(pick("low"), F.when(F.col("off") < F.col("final_"), F.col("end")))
    used = marked.where(F.col("first") >= F.col("start_"))
    joined_ = used.groupBy(*by, "chain_").agg(F.min("on").alias("on"), F.max("off").alias("off"), F.sum(pick("n")).alias("npts"), F.max(pick("top")).alias("top"), F.sum(pick("f")).alias("f"), F.sum(pick("c")).alias("c"), F.min(inner).alias("low_"))
    return alone.unionByName(joined_.select(*by, "on", "off", "npts", "top", mean("f", "c").alias("fold_mean"), "low_"))


def onsets(samples: DataFrame, thr_on: float, thr_off: float, max_len: int | None = None, by: Sequence[str] = BY, length: int = LENGTH, cut: bool = False) -> DataFrame:
    """on, off (sample numbers) of each trigger. cut: one longer than max_len ends there, instead of being dropped."""
    samples = samples if "fold" in samples.columns else samples.withColumn("fold", F.lit(None).cast("double"))
    found = _excursions(samples, thr_on, thr_off, by, length).select(*by, "on", "off")
    if max_len is None:
        return found
    return found.withColumn("off", F.least("off", F.col("on") + max_len)) if cut else found.where(F.col("off") - F.col("on") <= max_len)


def triggers(samples: DataFrame, thr_on: float, thr_off: float, max_len: int | None = None, pad: int = 0, min_fold: float | None = None, by: Sequence[str] = BY, length: int = LENGTH, cut: bool = False) -> DataFrame:
    """Triggers with their summary: samples, first maximum, mean fold over on to off. cut: as in onsets.

    min_fold rejects a trigger with a smaller fold in any sample from on to before off. Negative values are an error of the caller.
    """
    if max_len is not None and cut:  # where a trigger ends depends on where it began, so its samples are looked at again
        found = onsets(samples, thr_on, thr_off, max_len, by, length, cut).select(*by, F.col("on").alias("first"), F.col("off").alias("last"))
        inside = in_runs(samples, found, by, length).withColumn("on", F.col("first")).withColumn("off", F.col("last"))
        low = F.min(F.when(F.col("idx") < F.col("off"), F.col("fold")))
        top = F.max(F.struct(F.col("value").alias("value"), (-F.col("idx")).alias("back")))
        table = inside.groupBy(*by, "on", "off").agg(F.count("*").alias("npts"), top.alias("top"), F.avg("fold").alias("fold_mean"), low.alias("low_"))
    else:
        every = _excursions(samples, thr_on, thr_off, by, length)
        table = every if max_len is None else every.where(F.col("off") - F.col("on") <= max_len)
    kept = table if min_fold is None else table.where(F.coalesce("low_", F.lit(float("inf"))) >= min_fold)
    return kept.select(*by, "on", "off", F.greatest(F.col("on") - pad, F.lit(0)).alias("pad_on"), (F.col("off") + pad).alias("pad_off"), "npts", F.col("top.value").alias("p_max"), (-F.col("top.back")).alias("at_max"), "fold_mean")


def bounded(found: DataFrame, shortest: int, longest: int, mute_after: int | None = None) -> DataFrame:
    """Triggers of shortest to longest samples that end before the muted newest part."""
    inside = found.where((F.col("off") - F.col("on")).between(shortest, longest))
    return inside if mute_after is None else inside.where(F.col("off") < mute_after)


def picks(found: DataFrame, thr_on: float, step_us: int, origin_us: int = 0) -> DataFrame:
    """One pick a trigger, at its maximum: micros, uncertainties (s) to on and off, confidence (%), quality."""
    us = lambda idx: F.lit(origin_us) + F.col(idx) * step_us
    seconds = lambda a, b: (F.col(a) - F.col(b)) * (step_us / 1_000_000)
    return found.withColumns(
        {
            "pick_us": us("at_max"),
            "lower": seconds("at_max", "on"),
            "upper": seconds("off", "at_max"),
            "confidence": (1 - F.lit(float(thr_on)) / F.col("p_max")) * 100,
            "quality": shapes.quality(F.col("p_max")),
        }
    )


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str], modulus: int = 10_000) -> DataFrame:
    """rows with a message number that counts from 0 within each part and wraps at `modulus`."""
    return rows.withColumn("number", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % modulus)


def similar(picks_: DataFrame, within: float, keys: Sequence[str], mean: str = "mean", var: str = "var", row: str = "pick_id") -> DataFrame:
    """Pairs of picks of equal keys whose means differ by at most `within`, with their divergence, by bands in blocks."""
    found = pairs.near(picks_.select(*keys, row, mean, var), within, keys, mean).where(F.col(f"{row}_1") < F.col(f"{row}_2"))
    return found.withColumn("divergence", shapes.kl_gaussian(*(F.col(c) for c in (f"{mean}_1", f"{var}_1", f"{mean}_2", f"{var}_2"))))


def pick_times(rows: DataFrame, reference_us: str = "reference_us", params: str = "params", param: str = "pick_param", sampling_rate: str = "sampling_rate") -> DataFrame:
    """rows with pick_us: the reference time plus the named parameter (in samples)."""
    samples = F.try_element_at(F.col(params), F.col(param))
    return rows.withColumn("pick_us", F.col(reference_us) + F.rint(samples * 1_000_000 / F.col(sampling_rate)).cast("long"))


def models(samples: DataFrame, found: DataFrame, by: Sequence[str] = BY, quantiles: Sequence[float] = (0.16, 0.5, 0.84), length: int = LENGTH) -> DataFrame:
    """Parametric summaries of triggers (by, on, off): weighed moments and the sample numbers of quantiles, one row each."""
    spans = found.select(*by, F.col("on").alias("first"), F.col("off").alias("last"), "on", "off")
    inside = in_runs(samples, spans, by, length)
    keys = [*by, "on"]
    moments = measure.weighed_moments(inside, keys)
    at = measure.quantile_indices(inside, quantiles, keys, length).groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("idx"))).alias(f"q{round(100 * q)}") for q in quantiles])
    return found.select(*by, "on", "off").join(at, keys).join(moments, keys, "left")


def fitted_shapes(samples: DataFrame, found: DataFrame, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """Least-squares heights, and the norms of the rests, of a box over each trigger (by, on, off, at_max) and of a triangle that rises
    from before on to its maximum and falls to after off. Both are linear in the height, so two passes of sums do.
    """
    spans = found.select(*by, F.col("on").alias("first"), F.col("off").alias("last"), F.col("at_max").alias("top"))
    inside = in_runs(samples.where("value is not null"), spans, by, length)
    idx, y = F.col("idx"), F.col("value")
    rise, fall = (idx - F.col("first") + 1) / (F.col("top") - F.col("first") + 1), (F.col("last") + 1 - idx) / (F.col("last") + 1 - F.col("top"))
    shaped = inside.withColumn("shape_", F.when(idx <= F.col("top"), rise).otherwise(fall))
    keys = [*by, "first", "last", "top"]
    heights = shaped.groupBy(*keys).agg(F.avg(y).alias("box_height"), (F.sum(y * F.col("shape_")) / F.sum(F.col("shape_") * F.col("shape_"))).alias("triangle_height"))
    rest = lambda modelled: F.sqrt(F.sum(F.pow(y - modelled, 2)))
    both = shaped.join(heights, keys).groupBy(*keys, "box_height", "triangle_height")
    told = both.agg(rest(F.col("box_height")).alias("box_l2"), rest(F.col("triangle_height") * F.col("shape_")).alias("triangle_l2"))
    return told.select(*by, F.col("first").alias("on"), F.col("last").alias("off"), "top", "box_height", "box_l2", "triangle_height", "triangle_l2")
