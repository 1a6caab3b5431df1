"""Connected components of a large, sparse link table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import joined, stored


def connected(links: DataFrame, a: str = "a", b: str = "b", told: Callable[[int], None] | None = None) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has a link.

    Each round offers the smallest root among a node's neighbours to the node and to its present root, then jumps to the
    root's root. Whole trees hang themselves below smaller ones in this way, so rounds follow the logarithm of the number of nodes (a
    chain of 1,024 nodes takes 10 to 17, whatever its order). Links and roots stay distributed; every round is written to
    the shared folder. Minima are combined before they are shuffled, and joins deal the rows of hot nodes by a salt, so a hub or
    a giant component is no one task's work. told: is given the number of rounds.
    """
    both = stored(links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    roots = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    rounds, size = 0, both.count()
    while True:
        rounds += 1
        near = joined(both, roots.select(F.col("node").alias("other"), "root"), "other", "node", size).groupBy("node").agg(F.min("root").alias("near"))
        least = F.least("root", "near").alias("next")
        offers = F.array(F.struct("node", least, F.col("root").alias("held")), F.struct(F.col("root").alias("node"), least, F.lit(None).alias("held")))
        offered = roots.join(near, "node").select(F.explode(offers).alias("x")).select("x.*").groupBy("node").agg(F.min("next").alias("next"), F.max("held").alias("held"))
        above = roots.select(F.col("node").alias("next"), F.col("root").alias("top"))
        root = F.least("next", "top")
        after = stored(joined(offered, above, "next", "node", size).select("node", root.alias("root"), (root < F.col("held")).alias("moved")))
        if after.where("moved").isEmpty():
            if told is not None:
                told(rounds)
            return after.select("node", "root")
        roots = after.select("node", "root")
