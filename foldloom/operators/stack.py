"""Merging and stacking: several contributions to the same sample of a series become one.

Samples are rows (id, idx, value, fold); a masked sample has a null value and fold 0. The fold of a stack is the sum of
its contributions' folds. Grouping by (id, idx) combines on the map side, and no group is larger than the number of
contributions to a sample, so it stays a partial and a final aggregate without any join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("drop", "max", "mean")


def stack(samples: DataFrame, method: str = "mean", by: Sequence[str] = ("id",)) -> DataFrame:
    """One row a sample. drop: a sample with more than one contribution is masked; max: the largest value, whatever its
    fold; mean: weighed by fold, a single contribution keeps its value, and a sum of folds of 0 is masked otherwise.
    """
    if method == "interpolate":
        raise NotImplementedError("interpolating takes two series, not a set of contributions; use bridged, or drop, max or mean")
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    live = F.col("value").isNotNull()
    fold = F.when(live, F.col("fold"))
    grouped = samples.groupBy(*by, "idx").agg(
        F.count("value").alias("n_"),
        F.max("value").alias("top_"),
        F.sum(fold).alias("fold_"),
        F.sum(F.col("value") * fold).alias("weighed_"),
    )
    single = F.col("n_") == 1
    value = {
        "drop": F.when(single, F.col("top_")),
        "max": F.col("top_"),
        "mean": F.when(single, F.col("top_")).when(F.col("fold_") != 0, F.col("weighed_") / F.col("fold_")),
    }[method]
    out = grouped.withColumn("value", value)
    return out.select(*by, "idx", "value", F.when(F.col("value").isNull(), 0.0).otherwise(F.col("fold_")).alias("fold"))


def collapse_identical(packets: DataFrame, keys: Sequence[str] = ("id", "start")) -> DataFrame:
    """Packets of one id, start and equal data become one, whose fold is the sum; before any stacking, for every method.

    Packets carry data and fold as bounded arrays; equality is that of whole arrays. Packets of equal folds are counted
    first, so a group of copies gathers its distinct fold arrays only.
    """
    counted = packets.groupBy(*keys, "data", "fold").count().withColumn("fold", F.expr("transform(fold, f -> f * count)"))
    added = F.expr("aggregate(folds, transform(data, x -> 0D), (a, f) -> zip_with(a, f, (p, q) -> coalesce(p, 0D) + coalesce(q, 0D)))")
    return counted.groupBy(*keys, "data").agg(F.collect_list("fold").alias("folds")).select(*keys, "data", added.alias("fold"))


def span(samples: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """by, first, last sample number of each series."""
    return samples.groupBy(*by).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def fill_gaps(samples: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Every sample number from a series' first to its last; missing ones are masked. Samples are unique by (by, idx)."""
    grid = span(samples, by).select(*by, F.explode(F.sequence("first", "last")).alias("idx"))
    return grid.join(samples, [*by, "idx"], "left").select(*by, "idx", "value", F.coalesce("fold", F.lit(0.0)).alias("fold"))


def extend(left: DataFrame, right: DataFrame, method: str = "mean", by: Sequence[str] = ("id",)) -> DataFrame:
    """Add the samples of right to left, merging where both have one."""
    return stack(left.unionByName(right), method, by)


def bridged(left: DataFrame, right: DataFrame, by: Sequence[str] = ("id",), gaps: bool = False) -> DataFrame:
    """left continued by right: where one ends within the other, the overlap becomes a straight line from the value of the one that is ending, at the overlap's
    first sample, to the value of the other at its last; folds add up. A series that lies within the other one's span is left out. With `gaps`, the samples
    between both lie on a line from the end of one to the start of the other, with fold 0; else they are missing.

    Lines take two values a series, joined on its key, so series may be of any length. A series of one side only stays as it is; where an end of a line is
    masked or missing, so is the line.
    """
    keys, both = list(by), []
    for side, rows in (("a", left), ("b", right)):
        both.append(span(rows, by).withColumnsRenamed({"first": f"{side}0_", "last": f"{side}1_"}))
    ends = both[0].join(both[1], keys)
    # x leads y: x0 < y0, and x1 < y1
    leads = F.when((F.col("a0_") < F.col("b0_")) & (F.col("a1_") < F.col("b1_")), "a").when((F.col("b0_") < F.col("a0_")) & (F.col("b1_") < F.col("a1_")), "b")
    inner = F.when(leads.isNull(), F.when((F.col("a0_") <= F.col("b0_")) & (F.col("a1_") >= F.col("b1_")), "b").otherwise("a"))
    start, end = F.greatest("a0_", "b0_"), F.least("a1_", "b1_")
    # the line from low_ (a sample of the leading one) to high_ (of the other): over an overlap, or over a gap, where both are turned round
    plan = ends.select(*keys, leads.alias("leads_"), inner.alias("inner_"), F.least(start, end).alias("low_"), F.greatest(start, end).alias("high_"), (start <= end).alias("overlap_"))
    told = plan.where("leads_ is not null")
    tagged = left.withColumn("side_", F.lit("a")).unionByName(right.withColumn("side_", F.lit("b")))
    marks = tagged.join(told, keys).where(((F.col("side_") == F.col("leads_")) & (F.col("idx") == F.col("low_"))) | ((F.col("side_") != F.col("leads_")) & (F.col("idx") == F.col("high_"))))
    lines = marks.groupBy(*keys).agg(F.max(F.when(F.col("side_") == F.col("leads_"), F.col("value"))).alias("from_"), F.max(F.when(F.col("side_") != F.col("leads_"), F.col("value"))).alias("to_"))
    known = plan.join(lines, keys, "left")
    rows = tagged.join(known, keys, "left").where(F.col("inner_").isNull() | (F.col("inner_") != F.col("side_")))
    inside = F.coalesce(F.col("leads_").isNotNull() & F.col("overlap_") & F.col("idx").between(F.col("low_"), F.col("high_")), F.lit(False))
    line = F.col("from_") + (F.col("to_") - F.col("from_")) * (F.col("idx") - F.col("low_")) / F.greatest(F.col("high_") - F.col("low_"), F.lit(1))
    merged = rows.withColumn("value", F.when(inside, line).otherwise(F.col("value")))
    out = merged.groupBy(*keys, "idx").agg(F.max("value").alias("value"), F.sum("fold").alias("fold"))
    out = out.withColumn("fold", F.when(F.col("value").isNull(), 0.0).otherwise(F.col("fold")))
    if not gaps:
        return out
    holes = known.where("leads_ is not null and not overlap_ and high_ > low_ + 1").withColumn("idx", F.explode(F.sequence(F.col("low_") + 1, F.col("high_") - 1)))
    return out.unionByName(holes.select(*keys, "idx", line.alias("value"), F.lit(0.0).alias("fold")))


def cast_values(samples: DataFrame, kind: str) -> DataFrame:
    """Cast values, and folds with them; integers truncate."""
    return samples.withColumns({"value": F.col("value").cast(kind), "fold": F.col("fold").cast(kind)})
