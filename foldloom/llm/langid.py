"""Language identification by prediction by partial matching (PPM).

For each language a context tree of bytes up to three deep is counted on a bounded sample of labelled texts. With the
counts frozen, the code length of a byte after a context follows by method C: a seen byte costs its share of count + kinds, an
unseen one costs the escape and then its code length one context shorter, with the bytes already ruled out excluded.
A tree keeps the bits of every seen (context, byte) and the escape of every context, each order in a sorted array, so its size is in
proportion to the language's sample and no context is left out. Workers lay the most frequent contexts of a block of languages out in one
dense table of code lengths, a fast path to the same numbers. The prediction is the language of least code length; its score is the posterior
probability under equal priors, 2^-length normalised over the languages.

Learning reads only text and lang, of rows that have both. The sample is about `sample_bytes` of text for each
language, drawn by a hash of doc_id; counts are summed and each language's tree is built on executors. Any number of languages is learned: the
driver passes the trees on in blocks of `block_languages`, one broadcast a block, of a size that the sample bounds. One block is one pass
over the texts; more blocks are a pass each, whose least code lengths meet by row, and a block's broadcast is released after its pass.

Defined results: `und` with score 0 for a null text, a text without a letter, or where nothing could be learned; equal
code lengths go to the language first in order; equal rows get equal results, repeated ones too; an empty table gives an empty
result; a very long text is scored in pieces of CHUNK_BYTES that begin with the bytes before them; further columns pass
unchanged, but for those named like a result, which it replaces.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import BROADCAST_ROWS, free, stored

DEPTH = 3
#: rows of 256 code lengths, one a context and language, that a worker lays out (32 MB), and contexts worked out at a time
DENSE_ROWS, SLICE = 32_768, 512
START = b"\n" * DEPTH
CHUNK_BYTES = 250_000
UNKNOWN = "und"


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each byte with the three before it, over lower-cased texts; and where each text's codes begin and end."""
    parts = [START + t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts] + DEPTH
    codes = np.zeros(len(data), np.uint32)
    codes[DEPTH:] = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    return codes, starts, ends


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted keys stand in sorted keys, and which do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Tree:
    """One language: by order, the bits of seen codes (context and byte) and the escape bits of contexts; and how often each longest context came."""

    seen: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]
    often: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, n: np.ndarray) -> Tree:
        """gram: codes of DEPTH + 1 bytes; n: their counts."""
        seen, escapes, often = [], [], np.zeros(0)
        shorter, chance = np.zeros(0, np.uint32), np.zeros(0)
        for k in range(DEPTH + 1):
            codes, inverse = np.unique(gram.astype(np.uint32) & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counted = np.bincount(inverse, n, len(codes))
            contexts, owner = np.unique(codes >> np.uint32(8), return_inverse=True)
            often, kinds = np.bincount(owner, counted, len(contexts)), np.bincount(owner, minlength=len(contexts))
            # what is seen after a context is seen after its end, too
            below = chance[_found(shorter, codes & np.uint32((1 << 8 * k) - 1))[0]] if k else np.full(len(codes), 1 / 256)
            left = 1 - np.bincount(owner, below, len(contexts))
            every = kinds == 256
            own = counted / np.where(every, often, often + kinds)[owner]
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(every, 0.0, -np.log2(kinds / (often + kinds) / left))
            seen.append((codes, -np.log2(own)))
            escapes.append((contexts, escape))
            shorter, chance = codes, own
        return cls(seen, escapes, often)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each code after those before it."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(DEPTH, -1, -1):
            own = codes[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            at, hit = _found(self.seen[k][0], own)
            out[left[hit]] += self.seen[k][1][at[hit]]
            left, own = left[~hit], own[~hit]
            at, known = _found(self.escapes[k][0], own >> np.uint32(8))
            out[left[known]] += self.escapes[k][1][at[known]]
        out[left] += 8.0
        return out.astype(np.float32)


class ContextTrees:
    """The trees of a block of languages. cost: bits of the contexts laid out (context x byte x language)."""

    def __init__(self, languages: list[str], trees: list[bytes]):
        self.languages, self.packed = languages, trees

    def __getstate__(self):
        return {"languages": self.languages, "packed": self.packed}

    def _unpack(self) -> None:
        """The trees, and the table of their most frequent contexts; state 0 stands for any other context."""
        self.trees = [pickle.loads(t) for t in self.packed]
        contexts, inverse = np.unique(np.concatenate([t.escapes[DEPTH][0] for t in self.trees]), return_inverse=True)
        often = np.bincount(inverse, np.concatenate([t.often for t in self.trees]), len(contexts))
        laid = contexts[np.lexsort([contexts, -often])[: DENSE_ROWS // len(self.trees) - 1]]
        self.state_of = np.zeros(1 << 8 * DEPTH, np.uint16)
        self.state_of[laid] = np.arange(1, len(laid) + 1)
        self.cost = np.zeros(((len(laid) + 1) * 256, len(self.trees)), np.float32)
        for first in range(0, len(laid), SLICE):
            part = laid[first : first + SLICE]
            codes = (part[:, None] << np.uint32(8) | np.arange(256, dtype=np.uint32)).ravel()
            for i, tree in enumerate(self.trees):
                self.cost[(first + 1) * 256 : (first + 1 + len(part)) * 256, i] = tree.bits(codes)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of every whole text in every language."""
        if not hasattr(self, "trees"):
            self._unpack()
        codes, starts, ends = _grams(texts)
        states = self.state_of[codes >> np.uint32(8)]
        cells = states.astype(np.int64) << 8 | (codes & np.uint32(255))
        other = np.nonzero(states == 0)[0]
        out = np.zeros((len(texts), len(self.languages)))
        full = np.nonzero(starts < ends)[0]
        for k, tree in enumerate(self.trees):
            bits = np.append(np.take(self.cost[:, k], cells).astype(np.float64), 0.0)
            bits[other] = tree.bits(codes[other])
            out[full, k] = np.add.reduceat(bits, np.stack([starts[full], ends[full]], 1).ravel())[::2] if len(full) else 0
        return out

    def whole_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, and the number of bytes of each text, for texts of any length: long ones are cut where a character ends."""
        parts, owner = [], []
        for k, t in enumerate(texts):
            for at in range(0, max(1, len(t)), CHUNK_BYTES):
                parts.append((t[max(0, at - DEPTH) : at], t[at : at + CHUNK_BYTES]))
                owner.append(k)
        bits, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and size < CHUNK_BYTES:
                size += len(parts[end][1])
                end += 1
            before, own = [b for b, _ in parts[at:end]], [t for _, t in parts[at:end]]
            told = self.lengths([b + t for b, t in zip(before, own, strict=True)])
            if any(before):
                told -= self.lengths(before)
            np.add.at(bits, owner[at:end], told)
            np.add.at(sizes, owner[at:end], [len(t.lower().encode("utf-8", "replace")) for t in own])
            at = end
        return bits, sizes


@dataclass
class Languages:
    """The names of all languages, and the trees of each block of them, broadcast."""

    names: list[str]
    blocks: list[Broadcast]


def fit(docs: DataFrame, sample_bytes: int = 2_000_000, block_languages: int = 16) -> Languages:
    """Trees learned from text and lang of the given rows (doc_id, text, lang)."""
    spark = docs.sparkSession
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    totals = rows.groupBy("lang").agg(F.sum(F.octet_length("text") + 1).alias("size"))
    names = sorted(r["lang"] for r in totals.select("lang").collect())  # one short name a language
    fine = 1 << 30
    share = F.least(F.lit(float(fine)), F.lit(float(fine * sample_bytes)) / F.col("size"))
    sample = rows.join(F.broadcast(totals) if len(names) <= BROADCAST_ROWS else totals, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(fine)) < F.floor(share))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                codes, starts, ends = _grams(part["text"].tolist())
                inside = np.ones(len(codes), bool)
                inside[(starts[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
                grams, n = np.unique(codes[inside], return_counts=True)
                held.setdefault(lang, Counter()).update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
        for lang, found in held.items():
            yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})

    counts = sample.select("text", "lang").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gram")
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "tree": [pickle.dumps(Tree.of(rows["gram"].to_numpy(), rows["n"].to_numpy(np.float64)))]})

    grown = stored(counts.groupBy("lang").applyInPandas(grow, "lang string, tree binary"))
    blocks = []
    for part in [names[k : k + block_languages] for k in range(0, len(names), block_languages)]:
        own = {r["lang"]: bytes(r["tree"]) for r in grown.where(F.col("lang").between(part[0], part[-1])).collect()}
        if own:
            blocks.append(spark.sparkContext.broadcast(ContextTrees(sorted(own), [own[name] for name in sorted(own)])))
    return Languages(names if blocks else [], blocks)


def _told(block: Broadcast) -> Callable[[Column], Column]:
    """The language of least code length in one block, that length, the bytes, and the sum of 2^-(length - least) over the block."""

    @F.pandas_udf("struct<lang:string,least:double,size:long,weight:double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = block.value
        for batch in batches:
            bits, sizes = trees.whole_lengths([t or "" for t in batch])
            least = bits.min(axis=1, keepdims=True)
            yield pd.DataFrame({"lang": np.array(trees.languages, object)[bits.argmin(axis=1)], "least": least[:, 0], "size": sizes, "weight": np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)})

    return of.asNondeterministic()  # else a filter on its fields would run it twice


def predict(model: Languages, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs with lang_pred, score and bits_per_byte (of the least code length; null for `und`)."""
    if not model.names:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    told = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    told_, found_ = free(docs, "told"), free(docs, "found")
    if len(model.blocks) == 1:
        named = docs.withColumns({told_: told, found_: _told(model.blocks[0])(text)})
    else:
        row_ = free(docs, "row")
        rows = stored(docs.withColumns({row_: F.monotonically_increasing_id(), told_: told}))
        passes = []
        for block in model.blocks:
            passes.append(stored(rows.select(row_, _told(block)(text).alias("x")).select(row_, "x.*")))
            block.unpersist()
        first = F.min(F.struct("least", "lang", "size")).alias("m")
        every = reduce(DataFrame.unionByName, passes)
        best = every.groupBy(row_).agg(first)
        weight = F.sum(F.col("weight") * F.pow(F.lit(2.0), F.greatest(F.col("m.least") - F.col("least"), F.lit(-1000.0)))).alias("weight")
        summed = every.join(best, row_).groupBy(row_, "m").agg(weight)
        named = rows.join(summed.select(row_, F.struct(F.col("m.lang"), F.col("m.least"), F.col("m.size"), "weight").alias(found_)), row_).drop(row_)
    results = {
        "lang_pred": F.when(F.col(told_), F.col(f"{found_}.lang")).otherwise(UNKNOWN),
        "score": F.when(F.col(told_), 1 / F.col(f"{found_}.weight")).otherwise(0.0),
        "bits_per_byte": F.when(F.col(told_), F.col(f"{found_}.least") / F.greatest(F.col(f"{found_}.size"), F.lit(1))),
    }
    return named.select(*[c for c in docs.columns if c.lower() not in results], *[value.alias(name) for name, value in results.items()])
