"""Transforms of single series: trimming, scaling, tapering, detrending, resampling on the grid, calculus, and
characteristic functions. Rows are (id, idx, value, fold), one a sample. Whole-series numbers come from aggregates that join
back; neighbours and frames from chunked windows (see frames).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.operators.frames import LENGTH, framed, in_runs, run_bounds, running_sum
from foldloom.operators.stack import span

BY = ("id",)


def trim(samples: DataFrame, first: int, last: int, pad: bool = False, fill: float | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Samples first to last; pad: also numbers outside the series, masked, or `fill` with fold 0."""
    if first > last:
        raise ValueError("trim starts after its end")
    kept = samples.where(F.col("idx").between(first, last))
    if pad:
        grid = samples.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("idx"))
        kept = grid.join(kept, [*by, "idx"], "left")
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(float(fill)))
    return kept.select(*by, "idx", value.alias("value"), F.coalesce("fold", F.lit(0.0)).alias("fold"))


def _norm(how: str) -> Column:
    if how not in ("max", "std"):
        raise ValueError("norm must be max or std")
    return F.max(F.abs("value")) if how == "max" else F.stddev_pop("value")


def normalize(samples: DataFrame, how: str | float = "max", scope: str = "trace", by: Sequence[str] = BY) -> DataFrame:
    """Divide values by their largest magnitude, population deviation, or a number; scope `all`: by the largest norm of any
    series. A norm of zero leaves the values. Folds stay.
    """
    if not isinstance(how, str):
        return samples.withColumn("value", F.col("value") / F.lit(float(how)))
    norms = samples.groupBy(*by).agg(_norm(how).alias("norm_"))
    joined = samples.join(norms, list(by)) if scope == "trace" else samples.withColumn("norm_", norms.agg(F.max("norm_")).scalar())
    divided = F.when(F.col("norm_") > 0, F.col("value") / F.col("norm_")).otherwise(F.col("value"))
    return joined.withColumn("value", divided).drop("norm_")


def blind(samples: DataFrame, left: int, right: int | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Fold 0 in the first `left` and last `right` samples (of half a series at most); 0 leaves that edge."""
    right = left if right is None else right
    placed = samples.join(span(samples, by), list(by))
    half = F.floor((F.col("last") - F.col("first") + 1) / 2)
    edge = (F.col("idx") < F.col("first") + F.least(F.lit(left), half)) | (F.col("idx") > F.col("last") - F.least(F.lit(right), half))
    return placed.withColumn("fold", F.when(edge, 0.0).otherwise(F.col("fold"))).drop("first", "last")


def taper(samples: DataFrame, share: float = 0.05, most: int | None = None, side: str = "both", by: Sequence[str] = BY) -> DataFrame:
    """Half Hann windows at the ends, over int(min(most, share * n, n / 2)) samples a side; folds taper too."""
    placed = samples.join(span(samples, by), list(by))
    n = F.col("last") - F.col("first") + 1
    size = F.floor(F.least(share * n, n / 2, *([F.lit(most)] if most is not None else [])))
    rise = lambda at: F.when(at < size, 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * at / size)).otherwise(1.0)
    left = rise(F.col("idx") - F.col("first")) if side in ("both", "left") else F.lit(1.0)
    right = rise(F.col("last") - F.col("idx")) if side in ("both", "right") else F.lit(1.0)
    return placed.withColumn("weight_", left * right).withColumns({"value": F.col("value") * F.col("weight_"), "fold": F.col("fold") * F.col("weight_")}).drop("first", "last", "weight_")


def demean(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    means = samples.groupBy(*by).agg(F.avg("value").alias("mean_"))
    return samples.join(means, list(by)).withColumn("value", F.col("value") - F.col("mean_")).drop("mean_")


def detrend(samples: DataFrame, how: str = "linear", by: Sequence[str] = BY) -> DataFrame:
    """linear: less the least-squares line over sample numbers; simple: less the line through the first and last sample; demean."""
    if how == "demean":
        return demean(samples, by)
    live = samples.where("value is not null")
    if how == "linear":
        lines = live.groupBy(*by).agg(F.regr_slope("value", "idx").alias("slope_"), F.avg("value").alias("level_"), F.avg("idx").alias("at_"))
    elif how == "simple":
        ends = live.groupBy(*by).agg(F.min(F.struct("idx", "value")).alias("a"), F.max(F.struct("idx", "value")).alias("b"))
        lines = ends.select(*by, ((F.col("b.value") - F.col("a.value")) / F.nullif(F.col("b.idx") - F.col("a.idx"), F.lit(0))).alias("slope_"), F.col("a.value").alias("level_"), F.col("a.idx").alias("at_"))
    else:
        raise ValueError("how must be linear, simple or demean")
    line = F.col("level_") + F.coalesce("slope_", F.lit(0.0)) * (F.col("idx") - F.col("at_"))
    return samples.join(lines, list(by), "left").withColumn("value", F.col("value") - line).drop("slope_", "level_", "at_")


def segments(samples: DataFrame, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """first, last of each stretch of unmasked samples; a series without masks is one segment."""
    return run_bounds(samples, by, F.col("value").isNotNull(), length)


def split(samples: DataFrame, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """Unmasked samples with the bounds of their segment."""
    live = samples.where("value is not null")
    return in_runs(live, segments(samples, by, length), by, length)


def differentiate(samples: DataFrame, sampling_rate: float = 1.0, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """Central differences, one-sided at the ends and beside gaps."""

    def make(w):
        near = lambda f, k: F.when(f("idx").over(w) == F.col("idx") + k, f("value").over(w))
        return {"back_": near(F.lag, -1), "ahead_": near(F.lead, 1)}

    both = (F.col("ahead_") - F.col("back_")) / 2
    one = F.coalesce(both, F.col("ahead_") - F.col("value"), F.col("value") - F.col("back_"))
    return framed(samples, by, 1, 1, make, length).withColumn("value", F.when(F.col("value").isNotNull(), one * sampling_rate)).drop("back_", "ahead_")


def integrate(samples: DataFrame, sampling_rate: float = 1.0, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """Cumulative trapezoids from 0 between neighbouring samples; a gap adds nothing."""
    beside = lambda w: F.lag("idx").over(w) == F.col("idx") - 1
    steps = framed(samples, by, 1, 0, lambda w: {"step_": F.when(beside(w), (F.col("value") + F.lag("value").over(w)) / 2 / sampling_rate)}, length)
    return running_sum(steps, by, F.coalesce("step_", F.lit(0.0)), "sum_", length).withColumn("value", F.col("sum_")).drop("sum_", "step_")


def decimate(samples: DataFrame, factor: int, by: Sequence[str] = BY) -> DataFrame:
    """Every factor-th sample from the first, renumbered; no filter."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    at = F.col("idx") - F.col("first")
    return samples.join(span(samples, by), list(by)).where(at % factor == 0).withColumn("idx", (F.col("first") / factor).cast("long") + (at / factor).cast("long")).drop("first", "last")


def interpolate(samples: DataFrame, factor: int, how: str = "linear", by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """`factor` samples for each step between neighbours, numbered on the finer grid. linear, nearest (a half goes back) or
    zero (the sample before). Folds are linear. No value is made across a gap or beside a mask.
    """
    if how not in ("linear", "nearest", "zero"):
        raise ValueError("how must be linear, nearest or zero")
    make = lambda w: {"idx_": F.lead("idx").over(w), "value_": F.lead("value").over(w), "fold_": F.lead("fold").over(w)}
    pairs = framed(samples, by, 0, 1, make, length)
    joined = (F.col("idx_") == F.col("idx") + 1) & F.col("value_").isNotNull() & F.col("value").isNotNull()
    steps = F.when(joined, F.sequence(F.lit(0), F.lit(factor - 1))).otherwise(F.array(F.lit(0)))
    fine = pairs.withColumn("k_", F.explode(steps))
    at = F.col("k_") / factor
    lerp = lambda a, b: F.when(F.col("k_") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * at)
    value = {"linear": lerp("value", "value_"), "nearest": F.when(at <= 0.5, F.col("value")).otherwise(F.col("value_")), "zero": F.col("value")}[how]
    return fine.select(*by, (F.col("idx") * factor + F.col("k_")).alias("idx"), value.alias("value"), lerp("fold", "fold_").alias("fold"))


def sta_lta(samples: DataFrame, nsta: int, nlta: int, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """Classic ratio of trailing mean squares; 0 where fewer than nlta consecutive samples end. Frames count sample numbers, so
    samples before a gap fall out of them in time.
    """
    if not 0 < nsta < nlta:
        raise ValueError("0 < nsta < nlta is needed")
    square = F.col("value") * F.col("value")

    def make(w):
        return {
            "sta_": F.avg(square).over(w.rangeBetween(-(nsta - 1), 0)),
            "lta_": F.avg(square).over(w.rangeBetween(-(nlta - 1), 0)),
            "full_": F.lag("idx", nlta - 1).over(w) == F.col("idx") - (nlta - 1),
        }

    ratio = F.when(F.col("full_") & (F.col("lta_") > 0), F.col("sta_") / F.col("lta_")).otherwise(0.0)
    return framed(samples, by, nlta - 1, 0, make, length).withColumn("value", ratio).drop("sta_", "lta_", "full_")


def z_detect(samples: DataFrame, nsta: int, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """The trailing mean square (of the last nsta sample numbers) less its mean, over its population deviation."""
    square = F.col("value") * F.col("value")
    short = framed(samples, by, nsta - 1, 0, lambda w: {"sta_": F.avg(square).over(w.rangeBetween(-(nsta - 1), 0))}, length)
    level = short.groupBy(*by).agg(F.avg("sta_").alias("mean_"), F.stddev_pop("sta_").alias("dev_"))
    scaled = F.when(F.col("dev_") > 0, (F.col("sta_") - F.col("mean_")) / F.col("dev_")).otherwise(0.0)
    return short.join(level, list(by)).withColumn("value", scaled).drop("sta_", "mean_", "dev_")


def align_start(series: DataFrame, sampling_rate: float, tolerance: float = 0.01) -> DataFrame:
    """start_us moved to the grid from 0: within `tolerance` of a sample it is relabelled, else the first grid time after it
    (`resampled` tells that values must be interpolated there).
    """
    place = F.col("start_us") * sampling_rate / 1_000_000
    near, after = F.rint(place), F.ceil(place)
    petty = F.abs(place - near) <= tolerance
    return series.withColumns({"aligned_us": F.rint(F.when(petty, near).otherwise(after) * 1_000_000 / sampling_rate).cast("long"), "resampled": ~petty})


def make_gappy(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mask samples from a quarter to half of each series; a generator of test data."""
    placed = samples.join(span(samples, by), list(by))
    n, at = F.col("last") - F.col("first") + 1, F.col("idx") - F.col("first")
    hidden = (at >= F.rint(0.25 * n)) & (at < F.rint(0.5 * n))
    return placed.withColumns({"value": F.when(~hidden, F.col("value")), "fold": F.when(hidden, 0.0).otherwise(F.col("fold"))}).drop("first", "last")


def remove_sensitivity(samples: DataFrame, gains: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Values divided by the gain of their series (columns by, gain); series without a gain stay."""
    joined = samples.join(gains.select(*by, "gain"), list(by), "left")
    return joined.withColumn("value", F.when(F.coalesce(F.col("gain"), F.lit(0.0)) != 0, F.col("value") / F.col("gain")).otherwise(F.col("value"))).drop("gain")
