import random

import numpy as np
import xxhash

from foldloom.llm import simhash
from foldloom.llm.common import joined
from foldloom.llm.components import connected
from foldloom.llm.entry_queries import QUERIES

from .conftest import documents


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_in_pieces():
    rng = random.Random(0)
    text = " ".join(f"Wört{rng.randrange(99)}\t" for _ in range(3000))
    for most in (7, 100, 1 << 20):
        assert simhash.simhash(text.encode(), most=most) & (1 << 64) - 1 == plain(text)
    for odd in ("", None, "one", "one two", "one two three", " \n "):
        assert simhash.simhash(odd and odd.encode()) & (1 << 64) - 1 == plain(odd)


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63 - 1, 200)
    b = a ^ (np.int64(1) << rng.integers(0, 63, 200))
    rows = spark.createDataFrame([(int(x),) for x in np.concatenate([a, b])], "fp long")
    packed = [r[0] & (1 << 64) - 1 for r in rows.select(simhash.embedding(rows["fp"])).collect()]
    counts = lambda fp: [(int(fp) >> 2 * s & 1) + (int(fp) >> 2 * s + 1 & 1) for s in range(32)]
    for x, y, p, q in zip(a, b, packed[:200], packed[200:], strict=True):
        manhattan = sum(abs(i - j) for i, j in zip(counts(x), counts(y), strict=True))
        assert (p ^ q).bit_count() == manhattan <= (int(x ^ y) & (1 << 64) - 1).bit_count()


def test_query_against_all_pairs(spark, folder):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    texts = list(base)
    for t in base[:40]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t, t.upper()]
    texts += ["", None, "x", "X"]
    rows = QUERIES["op2_simhash_near_dedup"](spark, folder(documents(*texts))).collect()
    prints = {k: plain(t) for k, t in enumerate(texts, 1)}
    expected = components(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{prints[k]:016x}", expected[k]) for k in prints}


def test_chunks_of_a_crowded_cell_lose_no_link(spark):
    rng = np.random.default_rng(2)
    prints = {0}
    while len(prints) < 300:  # a chain of close words around one base
        prints.add(int(rng.choice(sorted(prints))) ^ (1 << int(rng.integers(0, 20))))
    rows = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    expected = components(dict(enumerate(sorted(prints))))
    for cell_rows in (8, 1024):
        found = simhash.connected(simhash.links(rows, cell_rows=cell_rows)).collect()
        roots = {r["node"]: r["root"] for r in found}
        own = dict(enumerate(sorted(prints)))
        groups = {}
        for k, root in expected.items():
            groups.setdefault(root, set()).add(own[k])
        assert all({p for p in prints if roots.get(p, p) == min(g)} == g for g in groups.values())


def test_dedup_keeps_one_of_each_group(spark):
    t = " ".join(f"w{k}" for k in range(50))
    rows = spark.createDataFrame([(3, t), (1, t), (2, "other words are here"), (2, "other words are here"), (9, t.upper())], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in simhash.deduplicated(rows).collect()) == [(1, t), (2, "other words are here")]


def test_dedup_tells_rows_of_one_id_apart(spark):
    t = " ".join(f"w{k}" for k in range(50))
    rows = [(3, t, "a"), (1, t, "b"), (3, "a text of its own", "c"), (4, t.upper(), "d"), (4, t, "e"), (None, t, "f"), (None, "no id here", "g"), (None, "no id here", "h"), (None, "NO ID HERE", "i")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, twice string")).collect()
    assert sorted((str(r["doc_id"]), r["text"].lower()) for r in kept) == [("1", t), ("3", "a text of its own"), ("None", "no id here")]


def test_rounds_follow_the_logarithm(spark):
    chain = [1, *range(1024, 1, -1)]
    rounds = []
    links = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long")
    found = connected(links, told=rounds.append).collect()
    assert len(found) == 1024 and {r["root"] for r in found} == {1} and rounds[0] <= 30


def test_a_hub_is_dealt(spark):
    links = spark.range(1, 100_001).selectExpr("100001 as a", "id as b").unionByName(spark.createDataFrame([(200_000, 200_001)], "a long, b long"))
    rounds = []
    found = connected(links, told=rounds.append)
    assert {(r["root"], r["count"]) for r in found.groupBy("root").count().collect()} == {(1, 100_001), (200_000, 2)} and rounds[0] <= 4


def test_hot_keys_join_as_others(spark):
    rows = spark.range(500).selectExpr("case when id < 300 then 7 else id end as k", "id as s")
    one = spark.range(600).selectExpr("id as k", "id * 2 as v")
    assert sorted(joined(rows, one, "k", "s", hot_rows=40).collect()) == sorted(rows.join(one, "k").collect())
    hot = joined(rows, one, "k", "s", hot_rows=40)
    assert hot.columns == ["k", "s", "v"]
