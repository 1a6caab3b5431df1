import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from foldloom.llm.entry_queries import QUERIES
from foldloom.llm.sharding import jump_hash

from .conftest import documents


def jump_once(key, n):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50), st.integers(1, 200))
def test_jump_hash_is_the_published_one(keys, n):
    found = jump_hash(np.array(keys, np.int64), n)
    assert found.tolist() == [jump_once(k, n) for k in keys]


@given(st.integers(1, 64))
def test_growing_moves_rows_only_into_the_new_shard(n):
    keys = np.arange(2000) * 7919
    old, new = jump_hash(keys, n), jump_hash(keys, n + 1)
    assert set(new[old != new].tolist()) <= {n}


def test_query(spark, folder):
    texts = ["a", "é" * 10, "", None, *[f"text {k}" for k in range(500)]]
    rows = QUERIES["op1_jump_shards"](spark, folder(documents(*texts))).collect()
    by_id = {r["doc_id"]: r for r in rows}
    for k, t in enumerate(texts, 1):
        data = (t or "").encode()
        assert (by_id[k]["size"], by_id[k]["text_crc32"], by_id[k]["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert by_id[k]["grown_shard"] in (by_id[k]["shard"], 16)
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
