"""Ranked lexical search: WAND over shards of documents, whose heaps are merged.

`build_index` cuts the rows of each task into shards of bounded bytes and stores one row a shard: its documents in order of
doc_id with their lengths, and for every term the list of its documents and counts. All but the doc_ids are strings of bytes, numbers in as few bytes as
hold them, which the JVM hands on without taking them apart; a row group holds few shards. Collection statistics (documents, terms, and the documents
of each query term) come from the index. `search` walks every shard once for each query with the published pivot test: each term has the largest
impact of its list in the shard as a bound; terms are ordered by it, and those whose bounds together can't reach the heap's threshold lead no
search. Windows of documents are taken from the lists of the others only. A document is the next pivot if the bounds of the terms it is
known to hold, and of those not looked up yet, reach the threshold; lists of the smaller terms are looked up by binary search, the largest first,
and only for documents that are still pivots. What is left is scored whole and enters the heap of the best k, which a task carries from shard to
shard, so its threshold grows. The heaps of all tasks meet in two rounds by query.

Scores are integers: w * ((1000000000 * tf) div (1000 * tf + 20 * m)), summed over the query's distinct terms; w = floor(1000 * ln((2 N + 2) /
(2 df + 1))), m = 50 + (50 n N) div L. 64 bits hold them while n N stays below 10^17.

Defined results: a null or termless text matches nothing and doesn't count in N; a null or termless query gives no rows; equal scores rank by
ascending doc_id, null first; rows that repeat a doc_id are documents of their own; queries that repeat both id and text count once, others of one
id are ranked each for itself; empty tables give no rows; a very long text is a shard of its own; further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.common import short_batches, spans, stored

#: bytes that stand between terms become spaces, A-Z become a-z
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD_BYTES = 4_000_000
#: what a document counts for besides its text; it bounds the documents of a shard
DOCUMENT_BYTES = 64
#: shards of a row group, so that neither the writer nor the reader holds all of a file
GROUP_SHARDS = 4
WINDOW = 512
#: distinct query terms of one pass over the index; more queries take more passes
PASS_TERMS = 200_000


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass(frozen=True)
class Index:
    """shards: doc_ids, lengths, and for the term k: words[k], counts[k] documents of `docs` and as many of `tfs`, packed but for doc_ids; n
    documents with terms, and `total` terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def _posted(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the documents; words, the number of documents of each, and these with the counts, word by word."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)  # not its own __len__: that is a cycle, which keeps the words of shard after shard
    lengths, docs, parts = np.zeros(len(texts), np.int64), [], []
    for k, text in enumerate(texts):
        found = terms(text)
        ids, tf = np.unique(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), return_counts=True)
        lengths[k] = len(found)
        docs.append(np.full(len(ids), k))
        parts.append(np.stack([ids, tf]))
    both, owner = np.concatenate(parts, axis=1), np.concatenate(docs)
    order = np.argsort(both[0], kind="stable")
    return lengths, list(number), np.bincount(both[0], minlength=len(number)), owner[order], both[1][order]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, behind the bytes of each."""
    kind = np.min_scalar_type(numbers.max(initial=0)).newbyteorder("<")
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def build_index(docs: DataFrame) -> Index:
    """Store the posting lists of docs (doc_id, text), all terms of all texts."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[object, bytes]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            waiting.sort(key=lambda row: (row[0] is not None, row[0] or 0))
            lengths, words, counts, owner, tf = _posted([t for _, t in waiting])
            row = ([d for d, _ in waiting], _packed(lengths), b" ".join(words), _packed(counts), _packed(owner), _packed(tf), np.count_nonzero(lengths), lengths.sum())
            kinds = (pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["doc_ids", "lengths", "words", "counts", "docs", "tfs", "n", "total"])

        for batch in batches:
            for first, end in spans(pc.binary_length(batch.column(1)).to_pylist(), SHARD_BYTES):
                part = batch.slice(first, end - first)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if waiting and size + len(text) + DOCUMENT_BYTES > SHARD_BYTES:
                        yield shard()
                        waiting, size = [], 0
                    waiting.append((doc_id, text))
                    size += len(text) + DOCUMENT_BYTES
        if waiting:
            yield shard()

    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    schema = "doc_ids array<long>, lengths binary, words binary, counts binary, docs binary, tfs binary, n long, total long"
    with short_batches(docs.sparkSession):
        shards = stored(named.mapInArrow(post, schema), **{"parquet.block.row.count.limit": GROUP_SHARDS})
    row = shards.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()  # two numbers
    return Index(shards, row["n"] or 0, row["total"] or 0)


class Heap:
    """The best k (score, doc_id): greater scores first, then smaller ids, null before all."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def threshold(self) -> int:
        """What a score must reach to matter; one that equals it may still win by its doc_id."""
        return self.rows[0][0] if len(self.rows) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        row = (score, doc_id is None, -doc_id if doc_id is not None else 0)
        if len(self.rows) < self.k:
            heapq.heappush(self.rows, row)
        elif row > self.rows[0]:
            heapq.heapreplace(self.rows, row)

    def best(self) -> list[tuple[int, int | None]]:
        return [(score, None if null else -back) for score, null, back in self.rows]


class Shard:
    """Posting lists of one shard with the impacts of the terms in `weights` (term to number and w)."""

    def __init__(self, doc_ids: list, lengths: np.ndarray, words: list[bytes], counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, weights: dict[bytes, tuple[int, int]], n_docs: int, n_terms: int):
        self.doc_ids = doc_ids
        m = 50 + 50 * lengths.astype(np.int64) * n_docs // n_terms
        ends = np.cumsum(counts, dtype=np.int64)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for k, word in enumerate(words):
            known = weights.get(word)
            if known is not None:
                own = slice(ends[k] - counts[k], ends[k])
                held, tf = docs[own].astype(np.int64), tfs[own].astype(np.int64)
                impact = known[1] * (1_000_000_000 * tf // (1000 * tf + 20 * m[held]))
                self.lists[known[0]] = (held, impact, int(impact.max()))

    def search(self, query: list[int], heap: Heap) -> None:
        """Offer the heap every document whose score may enter it."""
        lists = sorted((self.lists[t] for t in query if t in self.lists), key=lambda x: x[2])
        if not lists:
            return
        bounds = np.array([x[2] for x in lists])
        below = np.concatenate([[0], np.cumsum(bounds)])  # below[k]: what the k smallest terms can add
        at, end = 0, len(self.doc_ids)
        while at < end:
            least = heap.threshold
            if below[-1] < least:
                return
            lead = int(np.searchsorted(below[1:], least))  # terms before `lead` can't reach the threshold by themselves
            # the next window begins at the first document of a leading list
            cut = [np.searchsorted(docs, at) for docs, _, _ in lists[lead:]]
            first = min((int(docs[c]) for (docs, _, _), c in zip(lists[lead:], cut, strict=True) if c < len(docs)), default=end)
            last = min(end, first + WINDOW)
            if first >= end:
                return
            held, score = np.zeros(last - first, np.int64), np.zeros(last - first, np.int64)
            for (docs, impact, bound), c in zip(lists[lead:], cut, strict=True):
                stop = c + np.searchsorted(docs[c:], last)
                held[docs[c:stop] - first] += bound
                score[docs[c:stop] - first] += impact[c:stop]
            pivots = np.nonzero((held > 0) & (held + below[lead] >= least))[0]
            reach = score[pivots]  # what is known of the score; the rest is bounded by what lies below
            for k in range(lead - 1, -1, -1):
                keep = reach + below[k + 1] >= least
                pivots, reach = pivots[keep], reach[keep]
                if not len(pivots):
                    break
                docs, impact, _ = lists[k]
                place = np.minimum(np.searchsorted(docs, pivots + first), len(docs) - 1)
                reach = reach + np.where(docs[place] == pivots + first, impact[place], 0)
            keep = reach >= least
            for p, total in zip((pivots[keep] + first).tolist(), reach[keep].tolist(), strict=True):
                if total >= heap.threshold:
                    heap.offer(total, self.doc_ids[p])
            at = last


def _weights(index: Index, queries: DataFrame) -> dict[bytes, tuple[int, int]]:
    """term to number and w, for the terms of one pass (a bounded number) that occur."""
    asked = queries.select(F.explode("words").alias("word")).distinct().toArrow()["word"].to_pylist()  # at most about PASS_TERMS terms
    shared = queries.sparkSession.sparkContext.broadcast(set(asked))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df = shared.value, defaultdict(int)
        for batch in batches:
            for words, counts in zip(*batch.columns, strict=True):
                for word, n in zip(words.as_py().split(), _unpacked(counts.as_py()).tolist(), strict=True):
                    if word in wanted:
                        df[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], ["word", "n"])

    listed = index.shards.select("words", "counts").mapInArrow(count, "word binary, n long")
    counted = listed.groupBy("word").agg(F.sum("n").alias("df")).toArrow()
    n = index.n_docs
    return {w: (k, math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))) for k, (w, df) in enumerate(zip(counted["word"].to_pylist(), counted["df"].to_pylist(), strict=True))}


def _passed(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: the heaps of all tasks for the queries (item, words) of one pass."""
    weights = _weights(index, queries)
    asked = queries.toArrow()
    numbered = {item: [weights[w][0] for w in set(words) if w in weights] for item, words in zip(asked["item"].to_pylist(), asked["words"].to_pylist(), strict=True)}
    shared = queries.sparkSession.sparkContext.broadcast((weights, numbered, index.n_docs, index.n_terms))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, numbered, n_docs, n_terms = shared.value
        heaps = {item: Heap(k) for item in numbered}
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, lengths, words, *lists = [c[r].as_py() for c in batch.columns]
                shard = Shard(doc_ids, _unpacked(lengths), words.split(), *map(_unpacked, lists), weights, n_docs, n_terms)
                for item, query in numbered.items():
                    shard.search(query, heaps[item])
        rows = [(item, doc_id, score) for item, heap in heaps.items() for score, doc_id in heap.best()]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    columns = ("doc_ids", "lengths", "words", "counts", "docs", "tfs")
    return index.shards.select(*columns).mapInArrow(walk, "item long, doc_id long, score long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    ranked = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every query (item_id, text)."""
    texts = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    words = F.transform(F.array_distinct(texts), lambda w: w.cast("binary"))
    asked = stored(queries.select("item_id", "text").distinct().select("item_id", words.alias("words")).where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()))
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0  # one number
    if not total or not index.n_terms:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    passes = -(-total // PASS_TERMS)
    found = None
    for p in range(passes):
        heaps = _passed(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p), k)
        found = heaps if found is None else found.unionByName(heaps)
    # the heaps of up to some hundred tasks meet first
    some = _best(found.withColumn("part", F.spark_partition_id() % 64), ["item", "part"], k)
    return _best(some.drop("rank"), ["item"], k).join(F.broadcast(asked.select("item", "item_id")) if total <= PASS_TERMS else asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
