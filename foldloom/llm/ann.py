"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample of the vectors: each node splits its part of the sample into `branches` clusters
until a part holds at most the sample's share of `leaf_rows` rows. Every row then walks down to one leaf, so the whole
table is indexed. A query walks the tree with a priority queue: it takes the node of the largest bound, an inner
product with the centre plus the query's length times the node's radius (weighed by `slack`), puts the children of an inner node
back and appends a leaf to its list. How many leaves a query visits is calibrated: sample queries are compared with
brute force over the sample's own rows, and leaves are added until `recall` of their true neighbours lie in them.

Neighbouring leaves are packed into bins of about `bin_rows` rows; a larger leaf is a bin of its own, cut into parts of
that size. A query is sent once to each bin that holds leaves on its list, with others of the same best bin, in groups of
about `group_queries`. A task multiplies one group by one part, a few queries at a time, leaves out what is not on a query's list, and returns at most k rows a query.
Equal vectors are one class with their k + 1 smallest ids (no query needs more), kept by salted top lists, so a vector
that a third of all rows share is one row of the index.

The tree has at most about sample_rows leaves, so a query's share of leaves is what calibration finds at that
resolution: on data without clusters the products grow with rows x queries x share.

Defined results: vectors that are null, zero or of another length than most, or hold a null, NaN or infinite
component, take no part; a null vec_id takes no part; rows that repeat a vec_id are rows of their own, as candidates and as
queries, and a query leaves out its own row only; ties go to the smaller vec_id; fewer candidates than k give all; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.common import stored

CELLS = 1 << 22  # products held at a time


@dataclass
class Tree:
    centres: np.ndarray  # of all nodes; node 0 is the root
    radii: np.ndarray
    children: list[list[int]]  # empty for a leaf

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node the nearest child."""
        at = np.zeros(len(vectors), np.int64)
        going = np.arange(len(vectors)) if self.children[0] else np.zeros(0, int)
        while len(going):
            for node in np.unique(at[going]):
                own = going[at[going] == node]
                kids = np.array(self.children[node])
                near = (self.centres[kids] ** 2).sum(axis=1) - 2 * vectors[own] @ self.centres[kids].T
                at[own] = kids[near.argmin(axis=1)]
            going = going[[bool(self.children[n]) for n in at[going]]]
        return at

    def visits(self, query: np.ndarray, most: int, slack: float) -> list[int]:
        """Leaves, best bin first."""
        bound = self.centres @ query + slack * np.sqrt(query @ query) * self.radii
        queue, out = [(-bound[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bound[child], child))
            else:
                out.append(node)
        return out


def _clusters(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means labels, started from distinct rows."""
    centres = rows[rng.choice(len(rows), k, replace=False)]
    label = np.zeros(len(rows), int)
    for _ in range(rounds):
        label = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        counts = np.bincount(label, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rows[rng.choice(len(rows), k)])
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def grow(rows: np.ndarray, branches: int, leaf_rows: int, seed: int = 0) -> Tree:
    rng, centres, radii, children = np.random.default_rng(seed), [], [], []

    def node(part: np.ndarray) -> int:
        own = len(centres)
        centre = part.mean(axis=0)
        centres.append(centre)
        radii.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1)).mean()))
        children.append([])
        if len(part) > leaf_rows:
            label = _clusters(part, min(branches, len(part)), rng)
            groups = [part[label == k] for k in np.unique(label)]
            if len(groups) > 1:
                children[own] = [node(g) for g in groups]
        return own

    node(rows)
    return Tree(np.stack(centres), np.array(radii), children)


def calibrate(tree: Tree, sample: np.ndarray, queries: np.ndarray, k: int, recall: float, slack: float) -> int:
    """The number of leaves that hold `recall` of the k best sample rows of the queries (numbers of sample rows)."""
    leaf = tree.leaf(sample)
    leaves = sum(not c for c in tree.children)
    need = []
    for row in queries:
        place = {n: i for i, n in enumerate(tree.visits(sample[row], leaves, slack))}
        near = sample @ sample[row]
        near[row] = -np.inf  # without itself, which an inner product need not put first
        best = np.argsort(-near, kind="stable")[:k]
        need += [place[n] for n in leaf[best]]
    return int(np.sort(need)[max(0, int(np.ceil(recall * len(need))) - 1)]) + 1 if need else 1


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector of the rows that take part; floats stay floats, which halves what is sent, and are multiplied as doubles."""
    values = F.col(vector) if table.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    return table.where(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).alias("vec_id"), values.alias("vector"))


def _smallest(rows: DataFrame, keep: int) -> DataFrame:
    """vector and ids: of each distinct vector the `keep` smallest ids; salted, so that no vector is one task's work."""
    hashed = rows.select("vector", "vec_id", F.xxhash64("vector").alias("h"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    own = Window.partitionBy("h", "vector", "salt").orderBy("vec_id")
    first = hashed.withColumn("n", F.row_number().over(own)).where(F.col("n") <= keep)
    per = first.groupBy("h", "vector", "salt").agg(F.collect_list("vec_id").alias("some"))
    return per.groupBy("h", "vector").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, keep).alias("ids")).select("vector", "ids")


def neighbours(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    recall: float = 0.96,
    sample_rows: int = 20_000,
    branches: int = 8,
    leaf_rows: int = 128,
    slack: float = 0.5,
    bin_rows: int = 65_536,
    group_queries: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    leaf_rows is the number of index rows aimed at in each leaf; sample_rows bounds what the driver fits the tree on,
    and so the tree and the table of leaves.
    """
    spark = table.sparkSession
    rows = stored(usable(table, vec_id, vector))
    kind = rows.schema["vec_id"].dataType.simpleString()
    first = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if first is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    rows = rows.where(F.size("vector") == first["width"])
    classes = stored(_smallest(rows, k + 1))
    count = classes.count()
    fine = 1 << 30
    share = min(1.0, sample_rows / count)
    drawn = classes.where(F.pmod(F.xxhash64("vector"), F.lit(fine)) < int(fine * share)).select("vector").toPandas()
    sample = np.stack(drawn["vector"].to_numpy()).astype(np.float64) if len(drawn) else np.zeros((1, first["width"]))
    sample = sample[np.lexsort(sample.T)]
    tree = grow(sample, branches, max(2, int(leaf_rows * len(sample) / count)))
    picked = np.random.default_rng(1).choice(len(sample), min(len(sample), 200), replace=False)
    most = calibrate(tree, sample, picked, min(k, len(sample) - 1), recall, slack) if len(sample) > 1 else 1
    grown = spark.sparkContext.broadcast((tree, most))

    @F.pandas_udf("int")
    def leaf_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(grown.value[0].leaf(np.stack(batch.to_numpy()).astype(np.float64)) if len(batch) else [], dtype="int32")

    placed = stored(classes.select("vector", "ids", leaf_of("vector").alias("leaf"), F.xxhash64("vector").alias("h")))
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # at most the tree's leaves
    bins, filled = {}, {}
    for leaf in (n for n in range(len(tree.children)) if sizes.get(n)):
        last = len(filled) - 1
        if last < 0 or filled[last] + sizes[leaf] > bin_rows:
            last += 1
        bins[leaf], filled[last] = last, filled.get(last, 0) + sizes[leaf]
    parts = {b: -(-n // bin_rows) for b, n in filled.items()}
    packed = spark.sparkContext.broadcast((bins, parts))

    @F.pandas_udf("array<struct<bin:int,part:int,leaves:array<int>>>")
    def sent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (tree, most), (bins, parts) = grown.value, packed.value
        for batch in batches:
            out = []
            for query in batch:
                lists: dict[int, list[int]] = {}
                for leaf in tree.visits(np.asarray(query, np.float64), most, slack):
                    if leaf in bins:
                        lists.setdefault(bins[leaf], []).append(leaf)
                out.append([{"bin": b, "part": p, "leaves": leaves} for b, leaves in lists.items() for p in range(parts[b])])
            yield pd.Series(out, dtype=object)

    # queries are grouped by their best bin, so that on clustered data a group goes to few bins
    asked = stored(rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), sent("vector").alias("to")).withColumn("home", F.col("to")[0]["bin"]))
    homes = asked.groupBy("home").agg(F.ceil(F.count("*") / group_queries).cast("int").alias("groups"))
    dealt = asked.join(homes, "home").withColumn("group", F.pmod(F.xxhash64("query_row"), F.col("groups")).cast("int"))
    left = dealt.select("query_row", "query_id", "query", "home", "group", F.explode("to").alias("to")).select("query_row", "query_id", "query", "home", "group", "to.*")
    # the table of leaves is as small as the tree; a part goes to the groups that ask for its bin
    leaf_bins = F.broadcast(spark.createDataFrame([(n, b, parts[b]) for n, b in bins.items()], "leaf int, bin int, parts int"))
    held = placed.join(leaf_bins, "leaf").select("leaf", "bin", F.pmod("h", F.col("parts")).cast("int").alias("part"), "vector", "ids")
    right = held.join(stored(left.select("bin", "part", "home", "group").distinct()), ["bin", "part"])

    def nearest(q, query, line, bound, vectors, ids_of) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows among those whose product reaches the bound."""
        # a hair below it, for products that differ by rounding only
        at = np.nonzero((line >= bound - 1e-9 * (1 + abs(bound) if np.isfinite(bound) else 0)) & np.isfinite(line))[0]
        lists = [ids_of.iat[i] for i in at]
        ids = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        score = np.repeat((vectors[at] * query).sum(axis=1), [len(x) for x in lists])
        same = np.repeat((vectors[at] == query).all(axis=1), [len(x) for x in lists])
        own = np.nonzero(same & (ids == q))[0][:1]  # one row of this id and vector is the query's own
        ids, score = np.delete(ids, own), np.delete(score, own)
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]

    def best(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            asked, vectors = (np.stack(x.to_numpy()).astype(np.float64) for x in (queries["query"], held["vector"]))
            leaves, leaf = np.unique(held["leaf"].to_numpy(), return_inverse=True)
            some, step = min(k + 1, len(vectors)), max(1, CELLS // len(vectors))
            for at in range(0, len(asked), step):
                part = queries.iloc[at : at + step]
                listed = np.stack([np.isin(leaves, x) for x in part["leaves"]])
                near = np.where(listed[:, leaf], asked[at : at + step] @ vectors.T, -np.inf)
                least = -np.partition(-near, some - 1, axis=1)[:, some - 1]
                for row, q, query, line, bound in zip(part["query_row"], part["query_id"], asked[at : at + step], near, least, strict=True):
                    out.append((row, q, *nearest(q, query, line, bound, vectors, held["ids"])))
        out = [(np.full(len(ids), row), np.full(len(ids), q), ids, score) for row, q, ids, score in out]
        names = ("query_row", "query_id", "vec_id", "score")
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame({c: [] for c in names})

    keys = ("bin", "part", "home", "group")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_row long, query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
