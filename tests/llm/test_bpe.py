import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foldloom.llm import bpe
from foldloom.llm.entry_queries import QUERIES

from .conftest import documents

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  \n\n x", "it's we'll", "<|endoftext|>", "日本語" * 40, "a" * 5000, "ab" * 3000, " " * 3000, "é" * 1500, "".join(random.Random(0).choice("etaoinshr") for _ in range(3000))]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ENCODER.encode([text])[0].tolist() == OTHER.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text_and_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    found = ENCODER.encode(texts)
    assert [x.tolist() for x in found] == [OTHER.encode_ordinary(t) for t in texts]
    tokens = [b""] * (1 + max(RANKS.values()))
    for data, rank in RANKS.items():
        tokens[rank] = data
    assert bpe.decoded(found, tokens) == [t.encode() for t in texts]


def test_rows_and_heap_agree():
    rng = random.Random(3)
    pieces = ["".join(rng.choice("aeinrst") for _ in range(n)).encode() for n in (2, 3, 17, 200, 900)]
    for p in pieces:
        assert ENCODER._rows([p])[0] == ENCODER._heap(p)


def test_query(spark, folder):
    texts = [*ODD, None]
    rows = {r["doc_id"]: r for r in QUERIES["op7_byte_bpe"](spark, folder(documents(*texts))).collect()}
    for k, t in enumerate(texts, 1):
        ids = OTHER.encode_ordinary(t or "")
        assert rows[k]["n_tokens"] == len(ids)
        assert rows[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
