"""Merkle manifests of datasets: a tree a source, a tree over the sources, and for every row its authentication path.

A node is the SHA-256 of the hex digests of up to `arity` successive nodes below it, until one node remains. Rows get their
places by a range partitioning on (source, order) and the counts of its partitions, so no source is sorted in one task. A tree
is worked up in rounds: each round cuts the nodes of a tree into aligned blocks of arity ** depth, one bounded group a block, and
the block roots are the nodes of the next round. Within a block, paths come by Merkle traversal: for each height the nodes of the
current run (which hold a leaf's siblings) and one treehash that grows the next run, leaf by leaf; the treehash with the lowest
open node goes first. So besides the block's leaves only a number of nodes in proportion to the height is held. The paths of a round's
blocks in later rounds, and of the source in the upper tree, are shared by their leaves and appended once a block.

Defined results: a null source is a source of its own and comes first; null doc_ids come first within their source; rows that
repeat a doc_id are leaves of their own, in the order of their leaf hashes, and equal rows too, in the order read; a source of one row has
that leaf as subroot, one source its subroot as root; null fields count as `-`, an empty text as a value of no bytes; a very long text is
hashed whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.common import joined, small, stored

Siblings = tuple[bytes, bytes]
PATH = "array<struct<left:binary,right:binary>>"
_PATH = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def node(parts: Sequence[bytes]) -> bytes:
    """The digest of the hex digests of successive nodes."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


class Treehash:
    """Grows the nodes of one height over leaves first to end - 1, a leaf a step; nodes that wait for others lie in `open`, by height."""

    def __init__(self, leaves: Sequence[bytes], height: int, first: int, end: int, arity: int):
        self.leaves, self.height, self.at, self.end, self.arity = leaves, height, first, min(end, len(leaves)), arity
        self.open: list[list[bytes]] = [[] for _ in range(height + 1)]

    def tail(self) -> int:
        """The lowest height with an open node, or the height to reach where none is open."""
        return next((h for h in range(self.height) if self.open[h]), self.height)

    def put(self, h: int, made: bytes) -> None:
        self.open[h].append(made)

    def step(self) -> None:
        self.put(0, self.leaves[self.at])
        self.at += 1
        for h in range(self.height):
            if len(self.open[h]) == self.arity or self.at == self.end and self.open[h]:
                self.put(h + 1, node(self.open[h]))
                self.open[h] = []
            elif self.at < self.end:
                break

    def nodes(self) -> list[bytes]:
        while self.at < self.end:
            self.step()
        return self.open[self.height]


class FirstRuns(Treehash):
    """A treehash of a whole block that keeps the first run of each height."""

    def __init__(self, leaves: Sequence[bytes], height: int, arity: int):
        self.runs: list[list[bytes]] = [[] for _ in range(height + 1)]
        super().__init__(leaves, height, 0, len(leaves), arity)

    def put(self, h: int, made: bytes) -> None:
        if len(self.runs[h]) < self.arity:
            self.runs[h].append(made)
        super().put(h, made)


def traversal(leaves: Sequence[bytes], levels: int, arity: int) -> tuple[bytes, Iterator[list[Siblings]]]:
    """The root of a block of at most arity ** levels leaves, and the siblings (left, right) of each leaf in turn, lowest level first."""
    whole = FirstRuns(leaves, levels, arity)
    root = whole.nodes()[0]

    def ahead(h: int, run: int) -> Treehash | None:
        size = arity ** (h + 1)
        return Treehash(leaves, h, run * size, (run + 1) * size, arity) if run * size < len(leaves) else None

    def paths() -> Iterator[list[Siblings]]:
        runs, grown = whole.runs[:levels], [ahead(h, 1) for h in range(levels)]
        path: list[Siblings] = [(b"", b"")] * levels
        for i in range(len(leaves)):
            for h in range(levels):
                place, inside = divmod(i, arity**h)
                if inside:
                    break
                own = place % arity
                path[h] = b"".join(runs[h][:own]), b"".join(runs[h][own + 1 :])
            yield path.copy()
            for _ in range(levels):
                waiting = [t for t in grown if t is not None and t.at < t.end]
                if waiting:
                    min(waiting, key=Treehash.tail).step()
            for h in range(levels):
                run, inside = divmod(i + 1, arity ** (h + 1))
                if inside:
                    break
                if grown[h] is not None:
                    runs[h], grown[h] = grown[h].nodes(), ahead(h, run + 1)

    return root, paths()


def depth_of(n: int, arity: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while arity**levels < n:
        levels += 1
    return levels


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """rows with idx, the place in its tree by `order` (ties as read), and n, the number of rows of the tree. tree: a column without nulls."""
    by = [tree, *order, "tie_"]
    ranged = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie_")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            trees = batch.column(batch.schema.get_field_index(tree))
            fresh = np.ones(n, bool)
            fresh[1:] = pc.not_equal(trees[1:], trees[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = trees[0].as_py() != last
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(fresh, at, -1))
            place = np.where(start < 0, at + held, at - start)
            last, held = trees[n - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(place)], [*batch.schema.names, "part_", "place_"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stored(ranged.mapInArrow(count, f"{kinds}, part_ long, place_ long"))
    # a row for each tree and partition that holds some of it
    counts = placed.groupBy(tree, "part_").agg(F.count("*").alias("count_"))
    every = Window.partitionBy(tree)
    before = every.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select(tree, "part_", F.coalesce(F.sum("count_").over(before), F.lit(0)).alias("first_"), F.sum("count_").over(every).alias("n")))
    return placed.join(small(offsets), [tree, "part_"]).withColumn("idx", F.col("first_") + F.col("place_")).drop("part_", "place_", "first_")


def _traversed(blocks: DataFrame, arity: int, depth: int) -> DataFrame:
    """blocks (n, hashes, ...) with root and the path of each member."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time: its paths are some ten times its hashes
                part = batch.slice(k, 1)
                n, hashes = part.column(part.schema.get_field_index("n"))[0].as_py(), part.column(part.schema.get_field_index("hashes"))[0].as_py()
                root, paths = traversal(hashes, min(depth, depth_of(n, arity)), arity)
                listed = pa.array([[[{"left": left, "right": right} for left, right in path] for path in paths]], pa.list_(_PATH))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([root], pa.binary()), listed], [*part.schema.names, "root", "paths"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return blocks.mapInArrow(walk, f"{kinds}, root binary, paths array<{PATH}>")


def _blocks(nodes: DataFrame, tree: str, payload: Sequence[str], arity: int, depth: int) -> DataFrame:
    """tree, block, n, members (idx, hash, payload), root, paths: one row for each arity ** depth successive nodes of a tree."""
    block = F.call_function("div", F.col("idx"), F.lit(arity**depth))
    members = F.sort_array(F.collect_list(F.struct("idx", "hash", *payload)))
    grouped = nodes.groupBy(tree, block.alias("block")).agg(F.max("n").alias("n"), members.alias("members")).withColumn("hashes", F.col("members.hash"))
    return stored(_traversed(grouped, arity, depth).drop("hashes"))


def _authenticated(nodes: DataFrame, tree: str, arity: int, depth: int) -> DataFrame:
    """tree, idx, path and root of every node (tree, idx, n, hash)."""
    blocks = _blocks(nodes, tree, (), arity, depth)
    each = _joined_upper(blocks, _upper(blocks, tree, arity, depth), tree).withColumn("m", F.explode(F.arrays_zip("members", "paths")))
    return each.select(tree, F.col("m.members.idx").alias("idx"), F.concat("m.paths", "upper").alias("path"), "root")


def _upper(blocks: DataFrame, tree: str, arity: int, depth: int) -> DataFrame:
    """tree, block, upper (the path of the block's root) and root (of the tree) of every block."""
    most = blocks.agg(F.max("n")).first()[0] or 0  # one number
    if most <= arity**depth:
        return blocks.select(tree, "block", F.lit(None).cast(PATH).alias("upper"), "root").withColumn("upper", F.coalesce("upper", F.array().cast(PATH)))
    above = blocks.select(tree, F.col("block").alias("idx"), F.ceil(F.col("n") / arity**depth).cast("long").alias("n"), F.col("root").alias("hash"))
    return stored(_authenticated(above, tree, arity, depth).select(tree, F.col("idx").alias("block"), F.col("path").alias("upper"), "root"))


def _joined_upper(blocks: DataFrame, upper: DataFrame, tree: str) -> DataFrame:
    return blocks.drop("root").join(upper, [tree, "block"])


def manifest(rows: DataFrame, source: str, order: Sequence[str], arity: int = 3, depth: int = 6) -> DataFrame:
    """The columns of rows (but source) with path, subroot and root. rows has `leaf`, a hex digest.

    path lists for each level, from the leaf to the root, the siblings left and right of the way, as bytes of their digests.
    """
    payload = [c for c in rows.columns if c not in (source, "leaf")]
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))).withColumn("hash", F.unhex("leaf")).drop("leaf", source)
    blocks = _blocks(numbered(keyed, "tree", [*order, "hash"]), "tree", payload, arity, depth)
    own = _upper(blocks, "tree", arity, depth)
    # the upper tree: its leaves are the subroots, one a source
    subroots = stored(own.where("block = 0").select(F.lit(0).alias("all"), "tree", F.col("root").alias("hash")))
    tops = numbered(subroots, "all", ["tree"])
    top = stored(_authenticated(tops, "all", arity, depth).join(tops.select("idx", "tree"), "idx").select("tree", F.col("path").alias("last"), F.col("root").alias("top")))
    shared = joined(own, top, "tree", "block").select("tree", "block", F.concat("upper", "last").alias("upper"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    each = _joined_upper(blocks, shared, "tree").select("upper", "subroot", "root", F.explode(F.arrays_zip("members", "paths")).alias("m"))
    hexed = lambda c: F.lower(F.hex(c))
    return each.select(*[F.col(f"m.members.{c}").alias(c) for c in payload], hexed("m.members.hash").alias("leaf"), F.concat("m.paths", "upper").alias("path"), hexed("subroot").alias("subroot"), hexed("root").alias("root"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings' hex digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex digest) and its path lead to."""
    return F.aggregate(path, leaf, lambda held, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), held, F.lower(F.hex(s["right"]))), 256))


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as byte count, colon and value, or - where it is null."""
    told = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents, half of them tampered with (see `tampered`)."""
    fields = ("doc_id", "source", "lang", "n_chars")
    text = F.col("text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & text.contains("\n")
    changed = F.when(tampered, leaf(*map(F.col, fields), F.replace(text, F.lit("\n"), F.lit(""))))
    rows = stored(docs.select("doc_id", "source", leaf(*map(F.col, fields), text).alias("leaf"), F.unhex(changed).alias("changed")))
    found = manifest(rows, "source", ["doc_id"])
    shown = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    told = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(shown, F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
