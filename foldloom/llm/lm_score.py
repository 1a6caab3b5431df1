"""Language-model scores by a weighted backoff automaton over all n-grams of the training texts.

Every n-gram of one to three words is counted, however rare. Smoothing is a hierarchy of Dirichlet priors (MacKay and
Peto, 1995), interpolated down to the add-one unigram: p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k), where h' is h
without its first word and k is `prior` of the length of h. A history met in training is a state; each n-gram met is an arc with its
log10 probability; the failure arc of h leads to h' and costs log10 k / (c(h) + k). The root's arcs are the unigrams.
Probabilities over all words, and one word never seen, add up to one in every state.

Counts stay sharded. Texts are cut into blocks of about `block_bytes`, stored compressed. A block sends each of its
distinct n-grams once, with how often its training texts hold it, to the shard of the n-gram's hash; a shard adds up
and returns the counts in the order asked; the block builds the part of the automaton that its texts can reach, and
walks it once from left to right. Words are hashed to 64 bits, n-grams to fingerprints of log2(bytes of all texts) +
`spare` bits (48 to 62), so that a fingerprint meets another n-gram's with about the same chance, 2^-`spare`, at any size.
A shard gets an n-gram at most once a block, so a very common one makes no large group, and the number of shards follows
the size of the texts.

Defined results: a null or wordless text has one token, the end; a null doc_id belongs to the training part; equal rows
each get their result; no training text means counts of zero; an empty table gives an empty result; a text over PIECE_BYTES
is worked on in pieces that carry two words over; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import pieces, stored

ORDER = 3
#: the end of a text; UTF-8 holds no such byte
END = b"\xff"
PIECE_BYTES = 1 << 20
SHARD_BYTES = 5_000_000
STRETCH = 256
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_COLUMNS = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection on 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: a random number for each byte value at each place of a word
PLACED = _mixed((np.arange(_COLUMNS * 256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of data, and where it begins."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~SPACE[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    letters = raw[inside]
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    told = PLACED[(place % _COLUMNS) << 8 | letters]
    far = np.nonzero(place >= _COLUMNS)[0]
    told[far] *= _mixed((place[far] // _COLUMNS).astype(np.uint64)) | np.uint64(1)
    return _mixed(np.add.reduceat(told, first) + sizes.astype(np.uint64)), starts


def _chained(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(history * np.uint64(0x9E3779B97F4A7C15) + word)


def _planes(values: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    """64-bit numbers, byte plane by byte plane, compressed."""
    return packer.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _values(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, data and, by piece of a text: row, ids, held, sizes (bytes), carried (words told by the piece before)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"block long, data binary, rows array<long>, ids array<{kind}>, held array<boolean>, sizes array<int>, carried array<int>"
    id_type = _arrow_type(docs, "doc_id")

    def told(number: int, held: list[tuple]) -> pa.RecordBatch:
        rows, ids, marks, parts, carried = zip(*held, strict=True)
        data = b"".join(parts)
        lists = (pa.array([list(rows)], pa.list_(pa.int64())), pa.array([list(ids)], pa.list_(id_type)), pa.array([list(marks)], pa.list_(pa.bool_())))
        sizes = (pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([list(carried)], pa.list_(pa.int32())))
        names = ["block", "data", "rows", "ids", "held", "sizes", "carried"]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([zstandard.compress(data, 3)], pa.binary()), *lists, *sizes], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 40
        held, size = [], 0
        for batch in batches:
            for doc_id, mark, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before: list[bytes] = []
                cut = list(pieces((data or b"").lower(), PIECE_BYTES)) or [b""]
                for k, part in enumerate(cut):
                    piece = b" ".join([*before, part, END if k == len(cut) - 1 else b""]) + b"\n"
                    held.append((row, doc_id, mark, piece, len(before)))
                    size += len(piece)
                    if k < len(cut) - 1:
                        before = (before + part.split())[1 - ORDER :]
                    if size >= block_bytes:
                        yield told(number, held)
                        number, held, size = number + 1, [], 0
                row += 1
        if held:
            yield told(number, held)

    return docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("data")).mapInArrow(run, fields)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


@dataclass
class Tokens:
    """The tokens of a block: their words' hashes, the piece of each and its place in there."""

    words: np.ndarray
    piece: np.ndarray
    place: np.ndarray
    first: np.ndarray  # first token of each piece
    carried: np.ndarray

    @classmethod
    def read(cls, data: bytes, sizes: list[int], carried: list[int]) -> Tokens:
        raw, counts, words = zstandard.decompress(data), [], []
        at = k = 0
        while k < len(sizes):
            end, upto = k, at
            while end < len(sizes) and (end == k or upto + sizes[end] - at <= PIECE_BYTES):
                upto += sizes[end]
                end += 1
            own, starts = hashed_words(raw[at:upto])
            words.append(own)
            counts.append(np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes[k:end]))))))
            at, k = upto, end
        size = np.concatenate(counts)
        first = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(size)), size)
        return cls(np.concatenate(words), piece, np.arange(len(piece)) - first[piece], first, np.array(carried, np.int64))

    @property
    def own(self) -> np.ndarray:
        """The tokens that were not carried over from the piece before."""
        return self.place >= self.carried[self.piece]

    def fingerprints(self, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: which tokens end an n-gram of this piece, and its fingerprint, odd for single words only."""
        out, history = [], self.words
        for n in range(ORDER):
            if n:
                history = np.concatenate((np.zeros(1, np.uint64), _chained(history[:-1], self.words[1:])))[: len(self.words)]
            ends = np.nonzero(self.place >= n)[0]
            out.append((ends, history[ends] >> np.uint64(65 - bits) << np.uint64(1) | np.uint64(n == 0)))
        return out


def _bounds(shards: int, bits: int) -> np.ndarray:
    """First fingerprint of every shard but the first."""
    return np.array([(k << bits) // shards for k in range(1, shards)], np.uint64)


def asked(held: DataFrame, bits: int, shards: int) -> DataFrame:
    """block, shard, prints, counts: the distinct n-grams of each block and how often its training texts hold them."""
    bounds = _bounds(shards, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            for block, data, held, sizes, carried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = Tokens.read(data, sizes, carried)
                training = ~np.array(held, bool)[tokens.piece] & tokens.own
                keys = np.concatenate([p << np.uint64(1) | training[ends].astype(np.uint64) for ends, p in tokens.fingerprints(bits)])
                keys.sort()
                prints = keys >> np.uint64(1)
                first = np.nonzero(np.diff(prints, prepend=~prints[:1]))[0]
                counts = np.add.reduceat((keys & np.uint64(1)).astype(np.int64), first)
                prints = prints[first]
                cut = np.concatenate(([0], np.searchsorted(prints, bounds), [len(prints)]))
                own = np.nonzero(np.diff(cut))[0]
                sent = [(_planes(np.diff(prints[a:b], prepend=np.uint64(0)), packer), _planes(counts[a:b], packer)) for a, b in zip(cut[own], cut[own + 1], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block)), pa.array(own.astype(np.int32)), pa.array([p for p, _ in sent], pa.binary()), pa.array([c for _, c in sent], pa.binary())],
                    ["block", "shard", "prints", "counts"],
                )

    return held.select("block", "data", "held", "sizes", "carried").mapInArrow(run, "block long, shard int, prints binary, counts binary")


def counted(messages: DataFrame) -> DataFrame:
    """block, shard, counts: the training counts of all blocks, in the order asked; and a row without block with the shard's tokens and kinds of words."""

    def add(table: pa.Table) -> pa.Table:
        packer = zstandard.ZstdCompressor(1)
        prints = [np.cumsum(_values(p), dtype=np.uint64) for p in table["prints"].to_pylist()]
        known = np.concatenate(prints)
        known.sort()
        known = known[np.nonzero(np.diff(known, prepend=~known[:1]))[0]]
        totals = np.zeros(len(known), np.int64)
        places = [np.searchsorted(known, p).astype(np.int32) for p in prints]
        for place, counts in zip(places, table["counts"].to_pylist(), strict=True):
            totals[place] += _values(counts).astype(np.int64)
        single = totals[(known & np.uint64(1)).astype(bool)]
        shard = table["shard"].to_pylist()
        return pa.table(
            {
                "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
                "shard": pa.array([*shard, shard[0]], pa.int32()),
                "counts": pa.array([*(_planes(totals[p], packer) for p in places), None], pa.binary()),
                "tokens": pa.array([None] * len(shard) + [int(single.sum())], pa.int64()),
                "kinds": pa.array([None] * len(shard) + [int((single > 0).sum())], pa.int64()),
            }
        )

    return messages.groupBy("shard").applyInArrow(add, "block long, shard int, counts binary, tokens long, kinds long")


@dataclass
class Automaton:
    """What the tokens of a block can reach: for each token, by n-gram length, its arc and the failure arc of the state before it."""

    known: np.ndarray  # length x token: the n-gram that ends here was met in training
    arc: np.ndarray  # its cost
    loss: np.ndarray  # cost of leaving the state of the history of so many words

    @classmethod
    def build(cls, counts: np.ndarray, total: int, kinds: int, prior: tuple[float, ...]) -> Automaton:
        """counts: length x token, of the n-gram that ends at each token."""
        chance = (counts[0] + 1) / (total + kinds + 1)
        arc, loss = [np.log10(chance)], [np.zeros(counts.shape[1])]
        for n in range(1, ORDER):
            k, history = prior[n - 1], np.concatenate(([0.0], counts[n - 1, :-1]))
            chance = np.where(history > 0, (counts[n] + k * chance) / (history + k), chance)
            arc.append(np.log10(chance))
            loss.append(np.log10(k / (history + k)))
        return cls(counts > 0, np.stack(arc), np.stack(loss))

    def step(self, at: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read the tokens `at` from states of so many words: costs and the states reached, for many walks at once."""
        cost, going, reached = np.zeros(len(at)), state.copy(), np.zeros(len(at), np.int8)
        for n in range(ORDER - 1, 0, -1):
            here = going == n
            taken = here & self.known[n, at]
            failed = here & ~taken
            cost += np.where(taken, self.arc[n, at], 0.0) + np.where(failed, self.loss[n, at], 0.0)
            reached[taken] = min(n + 1, ORDER - 1)
            going[taken], going[failed] = -1, n - 1
        rooted = going == 0
        cost += np.where(rooted, self.arc[0, at], 0.0)
        reached[rooted] = self.known[0, at[rooted]]
        return cost, reached

    def walk(self, tokens: Tokens) -> np.ndarray:
        """The cost of each piece. Walks of at most STRETCH tokens go side by side; each reads the two words before it first,
        which settles the state, as no state looks further back."""
        sizes = np.bincount(tokens.piece, minlength=len(tokens.first))
        scored = sizes - tokens.carried
        n = -(-scored // STRETCH)
        owner = np.repeat(np.arange(len(n)), n)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        place = tokens.carried[owner] + turn * STRETCH
        warm = np.minimum(place, ORDER - 1)
        length = warm + np.minimum(STRETCH, scored[owner] - turn * STRETCH)
        order = np.argsort(-length, kind="stable")
        begin, warm, length = (tokens.first[owner] + place - warm)[order], warm[order], length[order]
        cost, state = np.zeros(len(order)), np.zeros(len(order), np.int8)
        for t in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -t, side="left"))
            more, state[:m] = self.step(begin[:m] + t, state[:m])
            cost[:m] += np.where(warm[:m] <= t, more, 0.0)
        return np.bincount(owner[order], cost, len(n))


def scores(held: DataFrame, returned: DataFrame, bits: int, total: int, kinds: int, prior: tuple[float, ...]) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base, cost of each piece."""
    kind = held.schema["ids"].dataType.elementType.simpleString()
    id_type = _arrow_type(held, "ids").value_type

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (own,) = left.to_pylist()
        tokens = Tokens.read(own["data"], own["sizes"], own["carried"])
        found = np.concatenate([_values(c) for _, c in sorted(zip(right["shard"].to_pylist(), right["counts"].to_pylist(), strict=True))])
        listed = tokens.fingerprints(bits)
        prints = np.concatenate([p for _, p in listed])
        order = np.argsort(prints)
        ranked = prints[order]
        rank = np.cumsum(np.diff(ranked, prepend=ranked[:1]) != 0, dtype=np.int32)
        del ranked
        prints[order] = found[rank]
        del order, rank, found
        counts, at = np.zeros((ORDER, len(tokens.words))), 0
        for n, (ends, _) in enumerate(listed):
            counts[n, ends] = prints[at : at + len(ends)]
            at += len(ends)
        del prints, listed
        automaton = Automaton.build(counts, total, kinds, prior)
        mine = tokens.own
        size, piece = len(own["rows"]), tokens.piece[mine]
        return pa.table(
            {
                "row": pa.array(own["rows"], pa.int64()),
                "doc_id": pa.array(own["ids"], id_type),
                "held_out": pa.array(own["held"], pa.bool_()),
                "n_tokens": pa.array(np.bincount(piece, minlength=size)),
                "n_known": pa.array(np.bincount(piece, counts[0, mine] > 0, size).astype(np.int64)),
                "base": pa.array(np.bincount(piece, automaton.arc[0, mine], size)),
                "cost": pa.array(automaton.walk(tokens)),
            }
        )

    fields = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, cost double"
    return held.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(run, fields)


def scored(docs: DataFrame, prior: tuple[float, ...] = (500.0, 4.0), block_bytes: int = 5_000_000, spare: int = 24) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text, held_out)."""
    held = stored(blocks(docs, block_bytes))
    size = held.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)).alias("bytes")).first()["bytes"]
    bits = min(62, max(48, ceil(log2(size + 2)) + spare))
    shards = max(1, -(-size // SHARD_BYTES))
    returned = stored(counted(asked(held, bits, shards)))
    told = returned.where("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    parts = scores(held, returned.where("block is not null").select("block", "shard", "counts"), bits, told["total"], told["kinds"], prior)
    return (
        parts.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("cost").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(told["total"]).cast("long").alias("train_tokens"), "base_score", "score")
    )
