"""Windows of several components: collation, validity, repair of missing components, and tensors.

Rows are samples of (instrument, k) windows with a component letter. The primary component must be valid; a rule repairs the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.operators.stack import stack

RULES = ("zeros", "primary", "secondary")


def collate(samples: DataFrame, components: Sequence[str], by: Sequence[str] = ("instrument",)) -> DataFrame:
    """One row a sample number with value_X and fold_X of each component, by one aggregate."""
    per = lambda what, c: F.max(F.when(F.col("component") == c, F.col(what))).alias(f"{what}_{c}")
    return samples.groupBy(*by, "idx").agg(*[per(what, c) for c in components for what in ("value", "fold")])


def validity(samples: DataFrame, length: int, primary: str, primary_share: float = 0.95, secondary_share: float = 0.8, threshold: float = 1.0, tolerance: float = 1e-3, by: Sequence[str] = ("instrument", "k")) -> DataFrame:
    """valid_fraction of each component of each window, and whether it passes its threshold."""
    share = F.sum(F.when(F.col("fold") >= threshold, 1).otherwise(0)) / F.lit(length)
    wanted = F.when(F.col("component") == primary, primary_share).otherwise(secondary_share)
    return samples.groupBy(*by, "component").agg(share.alias("valid_fraction")).withColumn("passes", F.col("valid_fraction") + tolerance >= wanted)


def fill_components(samples: DataFrame, length: int, components: Sequence[str], rule: str = "primary", by: Sequence[str] = ("instrument", "k"), **thresholds: float) -> DataFrame:
    """Every component of every window whose primary (the first) passes; other windows are left out.

    A secondary component that fails is replaced: by zeros, by the primary, or by the first secondary that passes (the
    primary if none). Replacements have fold 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    primary = components[0]
    passing = validity(samples, length, primary, by=by, **thresholds).where("passes")
    good = passing.groupBy(*by).agg(F.collect_set("component").alias("good")).where(F.array_contains("good", primary))
    other = F.coalesce(*[F.when(F.array_contains("good", c), F.lit(c)) for c in components[1:]], F.lit(primary))
    donor = {"zeros": F.lit(None).cast("string"), "primary": F.lit(primary), "secondary": other}[rule]
    wanted = good.withColumn("component", F.explode(F.array(*[F.lit(c) for c in components]))).withColumn("kept", F.array_contains("good", F.col("component")))
    plan = wanted.select(*by, "component", "kept", F.when(F.col("kept"), F.col("component")).otherwise(donor).alias("donor"))
    given = samples.select(*by, F.col("component").alias("donor"), "idx", "value", "fold")
    taken = plan.join(given, [*by, "donor"]).select(*by, "component", "idx", "value", F.when(F.col("kept"), F.col("fold")).otherwise(0.0).alias("fold"))
    if rule != "zeros":
        return taken
    blank = plan.where("donor is null").drop("donor", "kept").join(given.where(F.col("donor") == primary).select(*by, "idx"), list(by))
    return taken.unionByName(blank.select(*by, "component", "idx", F.lit(0.0).alias("value"), F.lit(0.0).alias("fold")))


def whole(samples: DataFrame, windows: DataFrame, by: Sequence[str] = ("instrument", "k")) -> DataFrame:
    """Every sample number (first to last of windows) of every component of samples; gaps have value 0 and fold 0."""
    each = samples.select(*by, "component").distinct().join(windows, list(by)).select(*by, "component", F.explode(F.sequence("first", "last")).alias("idx"))
    given = samples.select(*by, "component", "idx", "value", "fold")
    fold = F.when(F.col("value").isNull(), 0.0).otherwise(F.coalesce("fold", F.lit(0.0)))
    return each.join(given, [*by, "component", "idx"], "left").select(*by, "component", "idx", F.coalesce("value", F.lit(0.0)).alias("value"), fold.alias("fold"))


def tensor(samples: DataFrame, components: Sequence[str], length: int, by: Sequence[str] = ("instrument", "k")) -> DataFrame:
    """Windows as arrays (component x sample) of floats; windows without all components and samples are left out.

    A window has a fixed number of samples, so its lists are bounded.
    """
    lists = samples.where("value is not null").groupBy(*by, "component").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("s")).where(F.size("s") == length)
    each = lists.select(*by, "component", F.transform("s", lambda x: x["value"].cast("float")).alias("values"))
    maps = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("component", "values"))).alias("m"))
    return maps.where(F.size("m") == len(components)).select(*by, F.array(*[F.col("m")[c] for c in components]).alias("tensor"))


def target_checks(windows: DataFrame, start_us: Column, sampling_rate: float, npts: int) -> DataFrame:
    """Whether a window's start, rate and number of samples are those asked for."""
    return windows.withColumns({"start_ok": F.col("start_us") == start_us, "rate_ok": F.col("sampling_rate") == sampling_rate, "npts_ok": F.col("npts") == npts})


def header(samples: DataFrame, primaries: Sequence[str], by: Sequence[str] = ("instrument",)) -> DataFrame:
    """The first primary component of each group and where it starts; groups without one are left out."""
    first = F.min(F.struct(F.col("idx"), F.col("component"))).alias("h")
    return samples.where(F.col("component").isin(list(primaries))).groupBy(*by).agg(first).select(*by, F.col("h.component").alias("primary"), F.col("h.idx").alias("start"))


def merge_windows(samples: DataFrame, by: Sequence[str] = ("instrument", "component"), method: str = "mean") -> DataFrame:
    """Stack the overlapping windows of a component again into one series."""
    return stack(samples, method, by)


def component_ids(primary_id: str, secondaries: Sequence[str]) -> list[str]:
    """The ids of all components of a window: the primary's, then those of the secondaries, in order."""
    return [primary_id, *[primary_id[:-1] + c for c in secondaries if c != primary_id[-1:]]]


def primary_of(samples: DataFrame, primary_id: str, key: str = "id") -> DataFrame:
    """The samples of a window's primary component."""
    return samples.where(F.col(key) == primary_id)
