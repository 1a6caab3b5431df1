"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the number of set bits in each segment. The
Manhattan distance of two embeddings is a lower bound of the Hamming distance, because one flipped bit changes one
count by one. The counts are kept in unary (0, 1, 2 as 00, 01, 11), so that the Manhattan distance is itself the number
of differing bits of two packed words.

Grid range-join: the segments are dealt to `blocks` blocks. A Manhattan distance of at most r leaves at least
blocks - r blocks without any difference, so each close pair shares a grid cell in at least one projection onto
blocks - r blocks. Every distinct fingerprint enters one cell of each projection; cells of one fingerprint go. Members
of a cell are compared by Manhattan distance first, then exactly, and a cell returns a spanning forest of its links
(never all pairs). Cells larger than `cell_rows` are cut into chunks, and each pair of chunks is one bounded group, so
no link is lost and no group is unbounded.

Defined results: a null or wordless text has fingerprint zero and links like any other; a null doc_id stands for no
smallest id (a component of null ids only has a null id); equal rows stay and share a component; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import pieces, small, stored
from foldloom.llm.components import connected

_EVEN = 0x5555555555555555
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
FINE = 1 << 26
_LANES = (np.arange(8) * 256)[None, :]


def _shingles(data: bytes, width: int, most: int) -> Iterator[list[int]]:
    """Lists of the hashes of successive shingles; bytes.lower and bytes.split know ASCII only, as asked."""
    held: list[bytes] = []
    seen = False
    for part in pieces(data.lower(), most):
        words = held + part.split()
        if len(words) >= width:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-width])).tolist()
            digest = xxhash.xxh64_intdigest
            yield [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
            seen = True
        held = words[-(width - 1) :] if width > 1 else []
    if held and not seen:
        yield [xxhash.xxh64_intdigest(b" ".join(held), 42)]


def simhash(data: bytes | None, width: int = 3, most: int = 1 << 20) -> int:
    """The fingerprint, as a signed number: a bit is set where over half the shingle hashes have it."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _shingles(data or b"", width, most):
        lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8) + _LANES
        ones += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in texts], dtype="int64")

    return of(text.cast("binary"))


def embedding(word: Column) -> Column:
    """Two-bit segment counts in unary."""
    low, high = word.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(word, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _projections(blocks: int, radius: int) -> list[int]:
    """Masks over packed segments, one for each choice of blocks - radius blocks."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    bits = [sum(3 << 2 * int(s) for s in part) for part in np.array_split(np.arange(32), blocks)]
    masks = [sum(chosen) for chosen in combinations(bits, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a bounded number of fingerprints."""
    even = np.uint64(_EVEN)
    low, high = words & even, (words >> np.uint64(1)) & even
    counts = low | high | ((low & high) << np.uint64(1))
    near = np.bitwise_count(counts[:, None] ^ counts[None, :]) <= radius
    i, j = np.nonzero(near)
    near[i, j] = np.bitwise_count(words[i] ^ words[j]) <= radius
    new, links = np.ones(len(words), bool), []
    for root in range(len(words)):
        if new[root]:
            new[root], front = False, [root]
            while front:
                at = front.pop()
                found = np.nonzero(near[at] & new)[0]
                new[found] = False
                links += [(at, int(k)) for k in found]
                front += found.tolist()
    return links


def links(prints: DataFrame, radius: int = 3, blocks: int | None = None, cell_rows: int = 1024) -> DataFrame:
    """Links a, b whose transitive closure is that of all pairs of fingerprints (column fp, distinct) within the radius.

    blocks: more of them make more projections and smaller cells. Six, or two more for each FINE-fold of fingerprints, so that few
    fingerprints share a cell by accident; the links are the same.
    """
    if blocks is None:
        blocks, size = radius + 3, prints.count()
        while size > FINE:
            blocks, size = blocks + 2, size // FINE

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def compare(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            words = np.asarray(group, np.int64)
            if len(words) == 2:
                a, b = int(words[0]), int(words[1])
                found = [(a, b)] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius else []
            else:
                found = [(int(words[i]), int(words[j])) for i, j in _forest(words.view(np.uint64), radius)]
            out.append([{"a": min(x), "b": max(x)} for x in found])
        return pd.Series(out)

    packed = embedding(F.col("fp"))
    cells = [F.xxhash64(F.lit(k), packed.bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(_projections(blocks, radius))]
    placed = prints.select("fp", F.explode(F.array(*cells)).alias("cell"))
    shared = placed.groupBy("cell").count().where("count > 1")
    chunks = F.ceil(F.col("count") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    grouped = (
        placed.join(shared, "cell")
        .select("cell", "fp", chunks.alias("chunks"))
        .select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .groupBy("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("group"))
        .where(F.size("group") > 1)
    )
    return grouped.select(F.explode(compare("group")).alias("link")).select("link.a", "link.b").distinct()


def _classified(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), and the fingerprints that stand for several rows or have links.

    The second is stored, so that a class of very many copies can be split where it is joined: fp, chosen (the smallest
    doc_id of the component and its text_hash; null ids come last), shared (true). Most rows are alone and not in it.
    """
    prints = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text")).alias("fp")))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = stored(prints.groupBy("fp").agg(F.min(own).alias("own"), F.count("*").alias("n")))
    roots = connected(links(classes.select("fp"), radius))
    linked = classes.join(roots, F.col("fp") == F.col("node"))
    firsts = linked.groupBy("root").agg(F.min("own").alias("first"))
    named = linked.join(firsts, "root").select("fp", "first")
    shared = classes.join(named, "fp", "left").where("n > 1 or first is not null")
    return prints, stored(shared.select("fp", F.coalesce("first", "own").alias("chosen"), F.lit(True).alias("shared")))


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    prints, shared = _classified(docs, radius)
    component = F.when(F.col("shared"), F.col("chosen.doc_id")).otherwise(F.col("doc_id"))
    return prints.join(shared, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def deduplicated(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs without the near copies: of each component one row stays, of its smallest doc_id (a null one only where all are).

    Rows are told apart by doc_id and text, so a row is never lost to another that repeats its doc_id. Only the rows to
    remove, and those met more than once, are joined to the texts.
    """
    prints, shared = _classified(docs, radius)
    placed = prints.join(shared, "fp")
    chosen = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_hash") == F.col("chosen.text_hash"))
    gone = small(stored(placed.where(~chosen).select("doc_id", "text_hash").distinct()))
    kept = docs.join(gone, _same(docs, gone), "left_anti")
    twice = small(stored(placed.where(chosen).groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")))
    if twice.isEmpty():
        return kept
    return kept.join(twice, _same(kept, twice), "left_anti").unionByName(kept.join(twice, _same(kept, twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def _same(docs: DataFrame, rows: DataFrame) -> Column:
    """Equal doc_id (a null equals itself) and text."""
    return docs["doc_id"].eqNullSafe(rows["doc_id"]) & (F.xxhash64(docs["text"]) == rows["text_hash"])
