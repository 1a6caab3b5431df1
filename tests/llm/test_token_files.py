"""Token files against the library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldloom.llm import token_files
from foldloom.llm.entry_queries import QUERIES

from .conftest import DOCUMENTS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as definition:
    WORDS = token_files.WordEncoder(definition.read())


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def own(text):
    return WORDS.whole(pa.array([text]))[0].tolist()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0̀́  　Σσßİ'sé")), max_size=60))
def test_words_as_whole_texts(text):
    assert own(text) == plain(text)


def test_remembered_words_stay_within_their_bound():
    asked = []
    held = token_files.Remembered(lambda w: asked.append(w) or w.encode() * 2, 10)
    for k in range(100):
        assert held["often"] == b"oftenoften" and held[str(k)] == str(k).encode() * 2
        assert len(held) <= 10 and len(held.older) <= 10
    assert held["x" * 70] and "x" * 70 not in held and asked.count("often") == 1


def test_letters_below_the_bound_are_encoded_as_the_library_does():
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    for text in [*letters, *(c + "a." for c in letters), *("x" + c + "!?" for c in letters), "".join(letters)]:
        assert own(text) == plain(text), text


def test_awkward_texts():
    rng = random.Random(0)
    texts = ["", "   ", "it's IT'S 've\t'll", "<|endoftext|> x<|startoftext|>", "a" * 5000, "\n\n\x1c\x1d a\x1eb", "é e ́", " ".join(chr(rng.randrange(32, 0xD7FF)) * rng.randrange(1, 4) for _ in range(2000))]
    for text in texts:
        assert own(text) == plain(text)
    ids, counts = WORDS.whole(pa.array(texts))
    assert counts.tolist() == [len(plain(t)) for t in texts] and ids.tolist() == [i for t in texts for i in plain(t)]
    long = "word one, two'll 12 " * 120_000
    assert own(long) == plain(long)


def test_query_against_whole_texts(spark, folder):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Über", "don't", "naïve", "12", "\n", "x" * 70, "日本語", "."]) for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = documents(*texts, None, "", (None, "first"), (None, None), (5, texts[4]), (5, "other"))
    rng.shuffle(rows)
    found = QUERIES["op13_token_files"](spark, folder(rows, clashing=True)).collect()
    want = sorted((repr(r[0]), len(plain(r[1])) + 1, crc([*plain(r[1]), 2])) for r in rows)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_files_are_pruned_by_their_metadata(spark, tmp_path):
    """A search for one document reads one row group of one file; the Bloom filter spares those that hold no such id."""
    rows = [(2 * k, f"text number {k} " * 5, None, None, None) for k in range(30_000)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    with open(PATH, encoding="utf-8") as file:
        files = token_files.write(docs, str(tmp_path / "ids"), file.read(), 2)
    ordered = files.read().select("doc_id", "part", "first", F.size("ids").alias("n")).join(files.starts(), "part").orderBy("doc_id").collect()
    assert [r["start"] + r["first"] for r in ordered] == np.cumsum([0, *(r["n"] for r in ordered[:-1])]).tolist()
    found = files.documents([31_000])
    assert "PushedFilters: [In(doc_id, [31000])]" in found._jdf.queryExecution().toString() or "EqualTo(doc_id,31000)" in found._jdf.queryExecution().toString()

    def read(df):
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return rows, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))

    got, n = read(found)
    assert [r["ids"] for r in got] == [[*plain("text number 15500 " * 5), 2]] and n <= 1000
    assert read(files.documents([31_001])) == ([], 0)  # within the limits of a row group, but in no Bloom filter
    assert read(files.documents([70_000])) == ([], 0)
