"""Joins of distributions: every pair by its nature (Cartesian), or pairs within a band of means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import shapes
from foldloom.sources.scratch import stored

#: rows of a band in one block; pairs that a task compares, and rows that it takes for that
BLOCK_ROWS = 1024
TASK_PAIRS = 1 << 24
TASK_ROWS = 1 << 20


def _named(df: DataFrame, k: int) -> DataFrame:
    return df.select(F.col("key").alias(f"key_{k}"), F.col("mean").alias(f"mean_{k}"), F.col("var").alias(f"var_{k}"))


def _measures(pairs: DataFrame) -> DataFrame:
    four = [F.col(c) for c in ("mean_1", "var_1", "mean_2", "var_2")]
    return pairs.withColumn("kl", shapes.kl_gaussian(*four)).withColumn("ssmd", shapes.ssmd(*four)).withColumn("tvd", shapes.variation_bound(F.col("kl"))).withColumn("score", shapes.reciprocal_score(F.col("kl")))


def all_pairs(stats: DataFrame) -> DataFrame:
    """Both directions of every pair of rows (key, mean, var). The result itself is quadratic: for tables of few groups."""
    return _measures(_named(stats, 1).join(_named(stats, 2), F.col("key_1") != F.col("key_2")))


def near(rows: DataFrame, within: float, by: Sequence[str] = (), mean: str = "mean") -> DataFrame:
    """by, c_1 and c_2 of each other column c: all pairs of rows of equal `by` whose means differ by at most `within`, both ways, a row with itself too.

    Each row meets its own band of means and two neighbours. A band is dealt into blocks of about BLOCK_ROWS rows, and each pair of blocks
    meets on its own: many rows in a band, or of one mean, make more pairs of blocks, no larger ones. The number of tasks follows the work.
    """
    band = F.floor(F.col(mean) / within).cast("long")
    # stored, so that both sides and any repeated task see a row in the same block
    held = stored(rows.withColumns({"band_": band, "row_": F.monotonically_increasing_id()}).where("band_ is not null"))
    sizes = held.groupBy(*by, "band_").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS))
    first = sizes.select(*by, F.col("band_").alias("band_1"), F.col("n").alias("n_1"), F.col("blocks").alias("blocks_1"), F.explode(F.array(*[F.col("band_") + k for k in (-1, 0, 1)])).alias("band_2"))
    met = stored(first.join(sizes.select(*by, F.col("band_").alias("band_2"), F.col("n").alias("n_2"), F.col("blocks").alias("blocks_2")), [*by, "band_2"]))
    work = F.col("n_1") * F.col("n_2") / TASK_PAIRS + (F.col("n_1") * F.col("blocks_2") + F.col("n_2") * F.col("blocks_1")) / TASK_ROWS
    tasks = int(met.agg(F.ceil(F.sum(work))).first()[0] or 1)
    # tasks of a given number are not merged; work for a single one is left to adaptive execution
    spread = lambda df, *c: df.repartition(tasks, *c) if tasks > 1 else df
    own = [c for c in rows.columns if c not in by]
    cell = [*by, "band_1", "block_1", "band_2", "block_2"]

    def side(k: int, other: int) -> DataFrame:
        named = spread(held.select(*by, *[F.col(c).alias(f"{c}_{k}") for c in own], F.col("band_").alias(f"band_{k}"), "row_"), "row_")
        placed = named.join(met.drop("n_1", "n_2"), [*by, f"band_{k}"]).withColumn(f"block_{k}", F.pmod(F.xxhash64("row_"), F.col(f"blocks_{k}")))
        dealt = placed.withColumn(f"block_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"blocks_{other}") - 1)))
        return spread(dealt.select(*cell, *[f"{c}_{k}" for c in own]), *cell)

    pairs = side(1, 2).join(side(2, 1).hint("shuffle_hash"), cell).where(F.abs(F.col(f"{mean}_1") - F.col(f"{mean}_2")) <= within)
    return pairs.select(*by, *[f"{c}_1" for c in own], *[f"{c}_2" for c in own])


def band_pairs(stats: DataFrame, within: float) -> DataFrame:
    """Both directions of the pairs whose means differ by at most `within`, by bands in blocks."""
    return _measures(near(stats.select("key", "mean", "var"), within).where("key_1 <> key_2"))


def overlapping(packets: DataFrame, scopes: DataFrame, by: str = "id") -> DataFrame:
    """Packets (start, end) with how they stand to the scope (first, last) of their id: joins, future or past."""
    joined = packets.join(scopes, by)
    place = F.when(F.col("start") > F.col("last"), "future").when(F.col("end") < F.col("first"), "past").otherwise("joins")
    return joined.withColumn("place", place)
