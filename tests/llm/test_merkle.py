"""Merkle manifests against plain trees."""

import hashlib
import random
import zlib

import pytest

from foldloom.llm import merkle
from foldloom.llm.entry_queries import ORACLES, QUERIES

from .conftest import documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes, arity=3):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + arity])) for k in range(0, len(last), arity)])
    return levels


def plain_path(levels, i, arity=3):
    """Pairs (left, right) of joined hex digests."""
    out = []
    for level in levels[:-1]:
        first = i // arity * arity
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + arity])))
        i //= arity
    return out


def plain(rows):
    """All columns of op11 by doc_id and leaf, for rows (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(field(r[0]) + field(r[3]) + field(r[2]) + field(r[4]) + field(text))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    top = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            path = plain_path(trees[s], i) + plain_path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            held = leaf(r, r[1].replace("\n", "")) if tampered else own
            for left, right in path:
                held = sha(left + held + right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), held, held == top[-1][0]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_traversal_gives_all_paths_within_logarithmic_memory(arity):
    for n in [*range(1, 60), 200]:
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        levels = plain_levels([x.hex() for x in leaves], arity)
        root, paths = merkle.traversal(leaves, len(levels) - 1, arity)
        assert root.hex() == levels[-1][0]
        for i, path in enumerate(paths):
            assert [(a.hex(), b.hex()) for a, b in path] == plain_path(levels, i, arity)
            state = paths.gi_frame.f_locals if paths.gi_frame else {}
            held = sum(map(len, state.get("runs", []))) + sum(len(x) for t in state.get("grown", []) if t is not None for x in t.open)
            assert held <= 4 * arity * len(levels)


def test_a_short_last_block_rises_to_the_full_height():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(2)]
    root, paths = merkle.traversal(leaves, 3, 3)
    want = sha(sha(sha(leaves[0].hex() + leaves[1].hex())))
    assert root.hex() == want and [len(p) for p in paths] == [3, 3]


def rows_of(n, seed, sources=("a", "b", None, "é", "z", "")):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(sources)
        out.append((None if k % 50 == 7 else k % (n - 5), rng.choice([None, "", "x\ny\n", f"text {k}\n", "straße\t\n\n"]), rng.choice(["en", None]), source, rng.choice([None, k])))
    return out + [(900, "lone", "en", "only one", 4)]


def test_query_against_plain_trees(spark, folder):
    rows = rows_of(300, 1)
    found = QUERIES["op11_merkle_manifest"](spark, folder(rows, clashing=True)).collect()
    assert sorted(map(repr, map(tuple, found))) == plain(rows)


@pytest.mark.parametrize("depth", [1, 2])
def test_rounds_of_small_blocks(spark, folder, depth):
    rows = rows_of(150, 2)
    docs = spark.createDataFrame([(*r, merkle_leaf(r)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string")
    found = merkle.manifest(docs.select("doc_id", "source", "leaf"), "source", ["doc_id"], depth=depth)
    folded = found.select("doc_id", "leaf", "root", merkle.folded(found.leaf, found.path).alias("again"), merkle.proof_digest(found.path).alias("proof"))
    got = sorted((repr(r["doc_id"]), r["leaf"], r["proof"]) for r in folded.collect())
    want = sorted((repr(x[0]), x[1], x[4]) for x in map(eval, plain(rows)))
    assert got == want and all(r["again"] == r["root"] for r in folded.collect())


def merkle_leaf(r):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(field(r[0]) + field(r[3]) + field(r[2]) + field(r[4]) + field(r[1]))


def test_one_row_and_one_source(spark, folder):
    for rows in (documents("one\n"), documents("one\n", "two", "three", "four\n")):
        assert sorted(map(repr, map(tuple, QUERIES["op11_merkle_manifest"](spark, folder(rows, name=f"n{len(rows)}")).collect()))) == plain(rows)


def test_sql_against_plain_trees(folder, tmp_path):
    import duckdb

    rows = [r for r in rows_of(300, 3) if r[0] is not None]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(map(repr, con.execute(ORACLES["op11_merkle_manifest"]).fetchall())) == plain(rows)
