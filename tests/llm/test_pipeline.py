import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F

from foldloom.llm import pii

from .conftest import documents
from .test_bpe import OTHER
from .test_decontaminate import brute
from .test_simhash import components, plain


def test_stages_take_effect(spark, folder):
    base = " ".join(f"word{k} then" for k in range(60))
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = documents(base, base.upper(), "1234 5678 !!", f"{leak} and more words here", "my address is 10.1.2.3 today", None)
    path = folder(rows, benchmark=[(1, leak)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        kept.append({r["doc_id"] for r in docs.collect()})
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "feistel_pseudonyms":
            assert "10.1.2.3" not in {r["doc_id"]: r["text"] for r in docs.collect()}[5]
    assert kept == [{1, 2, 4, 5}, {1, 4, 5}, {1, 5}, {1, 5}, {1, 5}]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == {1, 5}


def test_run_against_brute_force(spark, folder):
    """Stages two, three and five by brute force over what the first keeps; names of stage four by its own operator."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "the", "er", "ou", "in"]) for _ in range(rng.randrange(1, 4)))
    items = [(k, " ".join(word() + word() for _ in range(14))) for k in range(6)]
    texts = []
    for _ in range(50):
        parts = [word() for _ in range(rng.randrange(5, 80))]
        if rng.random() < 0.25:
            parts += items[rng.randrange(6)][1].split()[: rng.randrange(8, 14)]
        if rng.random() < 0.3:
            parts.append(rng.choice(["10.1.2.3", "4041894974608795", "+1 (988) 555-2485"]))
        texts.append(" ".join(parts))
    texts += [t.upper() for t in texts[:8]] + [t + " end" for t in texts[8:12]] + [None, "", "99 !!"]
    rows = documents(*texts)
    path = folder(rows, benchmark=items)

    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.language_id(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    assert set(kept) == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    roots = components({k: plain(t) for k, t in kept.items()})
    kept = {k: t for k, t in kept.items() if roots[k] == k}
    kept = {k: t for k, t in kept.items() if not brute([(k, t)], items)[k][4]}
    frame = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    named = {r["doc_id"]: r["text"] for r in pii.pseudonymized(frame, pii.session_key(spark)).collect()}
    assert any(named[k] != t for k, t in kept.items())
    expected = {}
    for k, t in named.items():
        ids = OTHER.encode_ordinary(t)
        expected[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, path).collect()}
    assert found == expected and 10 < len(found) < 50


def test_stored_tables_go(spark, folder, tmp_path):
    import os

    from foldloom.llm.common import discard, shared_folder, stored, temporary

    listed = lambda: {x for x in os.listdir(shared_folder(spark)) if x.startswith("table-")}
    before = listed()
    with temporary(spark) as kept:
        stored(spark.range(3))
        last = kept(spark.range(5))
        assert len(listed() - before) == 2
    assert len(listed() - before) == 1 and last.count() == 5
    discard(last)
    assert listed() == before
    path = folder(documents("a text of some words here", "another text of other words"))
    corpus_pipeline.run(spark, path).collect()
    assert len(listed() - before) == 1 and os.path.exists(f"{path}/documents.parquet")


def test_each_stage_takes_awkward_rows(spark, folder):
    rows = documents("one text of words", "one text of words", None, "", (None, "no id here at all"), (1, "the same id again"), "x" * 3000)
    path = folder(rows, benchmark=[(1, None), (None, "")])
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("gone", F.lit(1))
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).collect() == [], name
        kept = [(r["doc_id"], r["text"]) for r in stage(spark, docs, path).collect()] if name != "byte_bpe" else None
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "language_id":
            assert sorted(map(str, kept)) == sorted(str(x) for x in texts if x[1])
        elif name == "simhash_near_dedup":
            assert sorted(map(str, kept)) == sorted(map(str, [(1, "one text of words"), (3, None), (None, "no id here at all"), (1, "the same id again"), (7, "x" * 3000)]))
        elif kept is not None:
            assert sorted(map(str, kept)) == sorted(map(str, texts)), name
        else:
            assert stage(spark, docs, path).count() == len(texts)
