"""Aggregates over samples: coverage, norms, folds, weighed moments, quantiles, misfits and run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators.frames import LENGTH, running_sum
from foldloom.operators.series import segments

BY = ("id",)


def valid_fraction(samples: DataFrame, first: int, last: int, threshold: float = 1.0, by: Sequence[str] = BY) -> DataFrame:
    """Share of the sample numbers first to last whose fold reaches the threshold."""
    inside = samples.where(F.col("idx").between(first, last))
    return inside.groupBy(*by).agg((F.sum(F.when(F.col("fold") >= threshold, 1).otherwise(0)) / F.lit(last - first + 1)).alias("valid_fraction"))


def summary(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Sample numbers, masked ones, largest magnitude, population deviation and mean fold of each series."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("npts"),
        F.count_if(F.col("value").isNull()).alias("masked"),
        F.greatest(F.abs(F.max("value")), F.abs(F.min("value"))).alias("abs_max"),
        F.stddev_pop("value").alias("std"),
        F.avg("fold").alias("fold_mean"),
    )


def fold_counts(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return samples.groupBy(*by, F.ceil("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


def first_maximum(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The largest value and the smallest sample number that has it."""
    top = F.max(F.struct(F.col("value").alias("value"), (-F.col("idx")).alias("back")))
    return samples.where("value is not null").groupBy(*by).agg(top.alias("t")).select(*by, F.col("t.value").alias("p_max"), (-F.col("t.back")).alias("idx"))


def weighed_moments(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean, deviation, skewness and kurtosis of sample numbers with values as weights.

    The deviation divides by (k - 1) / k times the sum of weights, where k weights are not zero; skewness and kurtosis
    are means of the third and fourth power of (x - mean) over the deviation. Power sums are taken about the first sample number.
    """
    first = samples.groupBy(*by).agg(F.min("idx").alias("origin"))
    live = samples.where("value is not null").join(first, list(by)).withColumn("x", (F.col("idx") - F.col("origin")).cast("double"))
    powers = live.groupBy(*by, "origin").agg(F.count_if(F.col("value") != 0).alias("k"), *[F.sum(F.col("value") * F.pow("x", F.lit(float(p)))).alias(f"s{p}") for p in range(5)])
    raw = powers.where("s0 <> 0 and k > 1").withColumns({f"m{p}": F.col(f"s{p}") / F.col("s0") for p in range(1, 5)})
    m1, m2, m3, m4 = (F.col(f"m{p}") for p in range(1, 5))
    central = raw.withColumns(
        {
            "c2": m2 - m1 * m1,
            "c3": m3 - 3 * m1 * m2 + 2 * F.pow(m1, F.lit(3.0)),
            "c4": m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, F.lit(4.0)),
        }
    ).withColumn("std", F.sqrt(F.col("c2") * F.col("k") / (F.col("k") - 1)))
    return central.where("std > 0").select(
        *by,
        (F.col("origin") + m1).alias("mean"),
        "std",
        (F.col("c3") / F.pow("std", F.lit(3.0))).alias("skewness"),
        (F.col("c4") / F.pow("std", F.lit(4.0))).alias("kurtosis"),
    )


def quantile_indices(samples: DataFrame, quantiles: Sequence[float] = (0.16, 0.5, 0.84), by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """For each quantile the sample number where the cumulative share of values is nearest to it; the first of equals."""
    totals = samples.groupBy(*by).agg(F.sum("value").alias("total"))
    summed = running_sum(samples.where("value is not null"), by, F.col("value"), "sum_", length).join(totals.where("total <> 0"), list(by))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    near = summed.select(*by, "idx", (F.col("sum_") / F.col("total")).alias("share"), asked)
    best = F.min(F.struct(F.round(F.abs(F.col("q") - F.col("share")), 12).alias("d"), F.col("idx"))).alias("b")
    return near.groupBy(*by, "q").agg(best).select(*by, "q", F.col("b.idx").alias("idx"))


def misfit(rows: DataFrame, observed: Column, modelled: Column, by: Sequence[str] = BY) -> DataFrame:
    """Sum of magnitudes, root of squares, and R squared of residuals."""
    rest = observed - modelled
    stats = rows.groupBy(*by).agg(
        F.sum(F.abs(rest)).alias("l1"), F.sqrt(F.sum(rest * rest)).alias("l2"), F.sum(rest * rest).alias("ss"), (F.var_pop(observed) * F.count(observed)).alias("all")
    )
    return stats.select(*by, "l1", "l2", F.when(F.col("all") > 0, 1 - F.col("ss") / F.col("all")).alias("r_squared"))


def collapse_fold(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sum of folds of all components of a window or instrument at each sample number."""
    return samples.groupBy(*by, "idx").agg(F.sum("fold").alias("fold"))


def gap_counts(samples: DataFrame, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """Segments of unmasked samples, the gaps between them, and the longest segment."""
    runs = segments(samples, by, length)
    return runs.groupBy(*by).agg(F.count("*").alias("segments"), (F.count("*") - 1).alias("gaps"), F.max(F.col("last") - F.col("first") + 1).alias("longest"))


def retained(metrics: DataFrame, max_age_us: int, time: str = "start_us", end: str = "end_us") -> DataFrame:
    """Rows that start at most max_age_us before the latest end of all rows."""
    return metrics.where(F.col(time) >= metrics.agg(F.max(end)).scalar() - max_age_us)


def newest(rows: DataFrame, n: int, by: Sequence[str], time: str, *ties: str) -> DataFrame:
    """The n latest rows of each part; Spark keeps the n best of each task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(time), *ties)
    return rows.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= n).drop("place_")


def run_report(metrics: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Iterations, running time (s) and rate of each operator."""
    took = (F.col("end_us") - F.col("start_us")) / 1_000_000
    return metrics.groupBy(*by).agg(F.sum("niter").alias("niter"), F.sum(took).alias("runtime"), F.avg(took).alias("mean_runtime"), F.stddev_pop(took).alias("std_runtime"), F.min(took).alias("min_runtime"), F.max(took).alias("max_runtime")).withColumn(
        "rate", F.when(F.col("runtime") > 0, F.col("niter") / F.col("runtime"))
    )


def stop_reasons(runs: DataFrame, max_iter: str = "max_iter") -> DataFrame:
    """runs with stop, the reason why each ended, and niter, the iterations it counts.

    Needs in_init (items waiting at its start), done (iterations begun) and halted (the stage that stopped early: get, run, put or null).
    An iteration counts once its result is put.
    """
    early = F.col("halted").isin("get", "run", "put")
    stop = F.when(F.col("in_init") == 0, "nodata").when(early, F.concat(F.lit("early-"), F.col("halted"))).otherwise("max")
    niter = F.when(F.col("in_init") == 0, 0).when(F.col("halted") == "put", F.col("done")).when(early, F.col("done") - 1).otherwise(F.col(max_iter))
    return runs.withColumns({"stop": stop, "niter": niter.cast("long")})
