"""Ranked search against scoring of every document."""

import collections
import gc
import math
import random
import re
import weakref

import numpy as np
import pyarrow.parquet as pq
import pytest

from foldloom.llm import entry_queries, wand
from foldloom.llm.entry_queries import QUERIES

from .conftest import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    told = [(doc_id, terms(text)) for doc_id, text in docs]
    told = [x for x in told if x[1]]
    n, total = len(told), sum(len(w) for _, w in told)
    df = {}
    for _, w in told:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, w in told:
            m = 50 + 50 * len(w) * n // total
            weight = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))  # noqa: B023, E731
            score = sum(weight(t) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in set(terms(text)) if t in df)
            scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate([s for s in sorted(scores) if s[0] < 0][:k], 1)]
    return sorted(map(repr, out))


def prose(rng, n, some=200):
    return " ".join(f"w{min(rng.randrange(some), rng.randrange(some))}{rng.choice(['', ',', '.', '!'])}" for _ in range(n))


def made(seed, n):
    rng = random.Random(seed)
    docs = [prose(rng, rng.choice([3, 20, 60, 400])) for _ in range(n)]
    docs += [docs[0]] * 30 + [None, "", " . ", "Éa éA ÉA W1", "nothing_in common2"]
    items = [(k, prose(rng, rng.choice([1, 5, 40]))) for k in range(12)] + [(50, docs[3]), (51, None), (52, "-"), (53, "unheard of"), (54, "éA"), (1, "w1 w2"), (54, "éA"), (None, "w3 W3 w5")]
    return docs, items


@pytest.mark.parametrize("size, window", [(4_000_000, 512), (2_000, 512), (3_000, 7)])
def test_query_against_all_scores(spark, folder, monkeypatch, size, window):
    docs, items = made(size + window, 400)
    rows = documents(*docs, (None, docs[1]), (7, docs[9]), (7, docs[9]))
    index = wand.build_index(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")) if size == 4_000_000 else None
    if index is None:
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        monkeypatch.setattr(wand, "SHARD_BYTES", size)
        monkeypatch.setattr(wand, "WINDOW", window)
        index = wand.build_index(table)
        assert index.shards.count() > 20
    found = wand.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, map(tuple, found.collect()))) == brute([(r[0], r[1]) for r in rows], items)


def test_several_passes_over_the_index(spark, monkeypatch):
    docs, items = made(5, 100)
    rows = documents(*docs)
    monkeypatch.setattr(wand, "PASS_TERMS", 40)
    index = wand.build_index(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    found = wand.search(index, spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(repr, map(tuple, found.collect()))) == brute([(r[0], r[1]) for r in rows], items, 5)


def test_bounds_skip_documents(monkeypatch):
    """Once the heap is full of documents that hold a rare term, lists of a frequent term alone lead nowhere."""
    n = 5000
    docs = np.concatenate([np.arange(0, 100, 2), np.arange(n)]).astype(np.int32)
    shard = wand.Shard(list(range(n)), np.full(n, 10), [b"rare", b"common"], np.array([50, n]), docs, np.ones(len(docs), np.int32), {b"rare": (0, 9000), b"common": (1, 5)}, n, 10 * n)
    looked = []
    monkeypatch.setattr(wand.np, "searchsorted", lambda *a, f=np.searchsorted, **b: (looked.append(len(np.atleast_1d(a[1]))), f(*a, **b))[1])
    heap = wand.Heap(50)
    shard.search([0, 1], heap)
    assert sorted(d for _, d in heap.best()) == list(range(0, 100, 2))
    assert sum(looked) < 60  # of 5,000


def test_index_is_read_in_small_parts(spark, monkeypatch):
    """A row group holds few shards, so that a file of any length is not held whole; a shard holds few documents, however short; lists are bytes, not arrays."""
    monkeypatch.setattr(wand, "SHARD_BYTES", 2_000)
    docs = [f"w{k % 7} w{k}" for k in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = wand.build_index(spark.createDataFrame(documents(*docs), "doc_id long, text string, lang string, source string, n_chars long").coalesce(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    (path,) = index.shards.inputFiles()
    told = pq.ParquetFile(path.removeprefix("file:")).metadata
    assert told.num_rows > 50 and max(told.row_group(k).num_rows for k in range(told.num_row_groups)) <= 4
    sizes = [len(r["doc_ids"]) for r in index.shards.select("doc_ids").collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2_000 // 64
    assert {t for _, t in index.shards.select("words", "counts", "docs", "tfs").dtypes} == {"binary"}


def test_words_of_a_shard_go_with_it(monkeypatch):
    """Nothing of a shard waits for the garbage collector, which many words and few containers hardly ever start."""
    class Told(collections.defaultdict):
        pass

    gone = []
    monkeypatch.setattr(wand, "defaultdict", lambda *a: (made := Told(*a), weakref.finalize(made, gone.append, True))[0])
    gc.disable()
    try:
        lengths, words, *_ = wand._posted([b"a b a", b"b c"])
        assert (lengths.tolist(), words, gone) == ([3, 2], [b"a", b"b", b"c"], [True])
    finally:
        gc.enable()


def test_documents_are_read_without_a_second_copy(spark, folder, monkeypatch):
    asked = {}
    monkeypatch.setattr(entry_queries, "table", lambda s, d, name, f=entry_queries.table, **options: (asked.update({name: options}), f(s, d, name, **options))[1])
    found = QUERIES["op12_wand_search"](spark, folder(documents("a b", "c"), benchmark=[(1, "a")]))
    assert [(r["item_id"], r["doc_id"]) for r in found.collect()] == [(1, 1)]
    assert asked == {"documents": {"parquet.hadoop.vectored.io.enabled": "false"}, "benchmark": {}}


def test_packed_numbers():
    for numbers in ([], [0], [255, 0], [256, 3], [65_535], [65_536, 1], [2**32 - 1], [2**32, 7]):
        assert wand._unpacked(wand._packed(np.array(numbers, np.int64))).tolist() == numbers


def test_clashing_columns(spark, folder):
    docs, items = made(6, 30)
    path = folder(documents(*docs), benchmark=items, clashing=True)
    assert sorted(map(repr, map(tuple, QUERIES["op12_wand_search"](spark, path).collect()))) == brute(list(enumerate(docs, 1)), items)
