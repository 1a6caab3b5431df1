"""Byte-level BPE over rank files: encoding as tiktoken encodes ordinary text, and decoding.

Texts are cut by the given pattern. The distinct pieces that a task has not met yet are dealt to length buckets, one
padded numpy matrix each, in which every row is one piece. A second matrix holds the rank of each neighbouring pair,
found in an open-addressing hash table. Every round merges the leftmost pair of least rank in every row, so a round
shortens each row by one; rows without any mergeable pair are finished and removed. A piece that is itself a token is
that token. Pieces over LONG bytes would make wide matrices with as many rounds, so they merge by a heap instead, with
the same order of merges. Pieces met are remembered up to a bound.

Defined results: a null or empty text has no tokens and decodes to no bytes; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import spans

NONE = np.int32(2**31 - 1)
LONG = 1024
REMEMBERED = 120_000
CHUNK_BYTES = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a tiktoken file; read once, by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Open addressing with linear probing over (left, right) pairs; vectorised lookups."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 31 | right] = rank
        keys, values = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slots = self._slot(keys)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] == -1]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs, NONE where a pair doesn't merge or a side is padding (-1)."""
        keys = left.astype(np.int64) << 31 | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], NONE)
        open_ = np.nonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))[0]
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (1 << self.bits) - 1
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.pairs = ranks, regex.compile(pattern), PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.met: dict[str, bytes] = {}  # ids as packed int32

    def _rows(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of the pieces of one length bucket, merged together."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        filled = np.arange(width) < lengths[:, None]
        ids = np.full(filled.shape, -1, np.int32)
        ids[filled] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while True:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), int)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            ended = best == NONE
            done = ids[ended]
            packed, ends = done[done >= 0].tobytes(), np.cumsum((done >= 0).sum(axis=1)) * 4
            for row, first, end in zip(rows[ended].tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                out[row] = packed[first:end]
            go = ~ended
            if not go.any():
                return out
            rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            each, width = np.arange(len(rows)), ids.shape[1]
            ids[each, at] = best
            past = np.arange(width - 1)
            ids = np.take_along_axis(ids, past + (past > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, past[:-1] + (past[:-1] >= at[:, None]), axis=1) if width > 2 else ranks[:, :0]
            left, right = at > 0, at < width - 2
            ranks[each[left], at[left] - 1] = self.pairs.find(ids[each[left], at[left] - 1], ids[each[left], at[left]])
            ranks[each[right], at[right]] = self.pairs.find(ids[each[right], at[right]], ids[each[right], at[right] + 1])

    def _heap(self, piece: bytes) -> bytes:
        """One very long piece: the least (rank, place) first, over a linked list."""
        n = len(piece)
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.nonzero(first != NONE)[0]]
        heapq.heapify(heap)
        ids, rank = ids.tolist(), [*first.tolist(), int(NONE)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def renew(i: int) -> None:
            j = after[i]
            rank[i] = int(self.pairs.find(np.array([ids[i]]), np.array([ids[j]]))[0]) if j < n else int(NONE)
            if rank[i] != NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            best, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != best:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = best, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.met[piece] = whole.to_bytes(4, sys.byteorder)
            elif len(data) > LONG:
                self.met[piece] = self._heap(data)
            else:
                buckets.setdefault(len(data).bit_length(), []).append((piece, data))
        for bits, bucket in buckets.items():
            step = max(1, (1 << 18) >> bits)
            for k in range(0, len(bucket), step):
                part = bucket[k : k + step]
                self.met.update(zip((p for p, _ in part), self._rows([d for _, d in part]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.met) > REMEMBERED:
            self.met = {}
        self._learn(set().union(*cut).difference(self.met))
        return [np.frombuffer(b"".join(map(self.met.__getitem__, pieces)), np.int32) for pieces in cut]


def _listed(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).astype(np.int32), pa.int32()))


def decoded(ids: list[np.ndarray], tokens: list[bytes]) -> list[bytes]:
    """The bytes that each row of ids stands for."""
    return [b"".join(map(tokens.__getitem__, x.tolist())) for x in ids]


def tokenized(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary, from the ids) of every row.

    The rank table has a fixed size and is broadcast; texts pass through in slices of about CHUNK_BYTES.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        tokens = [b""] * (1 + max(shared.value.values()))
        for data, rank in shared.value.items():
            tokens[rank] = data
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for first, end in spans(sizes, CHUNK_BYTES):
                part = batch.slice(first, end - first)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), _listed(ids), pa.array(decoded(ids, tokens), pa.binary())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(tokens: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of ids and decoded bytes."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
