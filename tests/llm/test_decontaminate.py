import hashlib
import random
import re

from foldloom.llm import common, decontaminate
from foldloom.llm.entry_queries import QUERIES

from .conftest import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, width=10):
    out = {}
    for doc_id, text in texts:
        doc, hit, ids = words(text), set(), set()
        for item_id, item in items:
            item = words(item)
            n = min(width, len(item))
            for s in range(max(len(item) - width, 0) + 1 if item else 0):
                for p in range(len(doc) - n + 1):
                    if doc[p : p + n] == item[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item_id))
        out[doc_id] = (len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def make():
    rng = random.Random(5)
    text = lambda n, some=12: " ".join(rng.choice([f"w{rng.randrange(some)}", "Ünd", "É", "and"]) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 25, 40]))) for k in range(25)] + [(25, "a a a a a a a a a a a a"), (26, "short one"), (27, None), (28, "!!")]
    docs = []
    for k in range(60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            item = words(rng.choice(items)[1])
            if item:
                cut = rng.randrange(len(item))
                parts += [", ".join(item[cut : cut + rng.randrange(5, 30)]).upper(), text(rng.randrange(5))]
        docs.append((k, " - ".join(parts)))
    docs += [(60, "a " * 30), (61, None), (62, "short, ONE"), (63, words(items[3][1]) and " ".join(words(items[3][1]) * 3))]
    return docs, items


def test_query_against_brute_force(spark, folder):
    docs, items = make()
    rows = QUERIES["op8_positional_index"](spark, folder(documents(*docs), benchmark=items)).collect()
    expected = brute(docs, items)
    assert sum(x[4] for x in expected.values()) > 20
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == expected


def test_without_broadcasts(spark, monkeypatch):
    docs, items = make()
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    rows = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["n_hit"] for r in rows} == {k: v[1] for k, v in brute(docs, items).items()}


def test_clean_keeps_all_others(spark):
    docs, items = make()
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in brute(docs, items).items() if not v[4])


def test_proximity(spark):
    docs = [(1, "alpha x x beta"), (2, "alpha " + "x " * 30 + "beta"), (3, "beta alpha"), (4, "alpha alpha")]
    items = [(7, "beta and alpha")]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["first"], r["last"]) for r in decontaminate.proximity_hits(index, 5).collect()}
    assert found == {(1, 0, 3), (3, 0, 1)}
