"""Quality by the perplexity of an interpolated modified Kneser-Ney model (Chen and Goodman, 1999) over bytes.

Trigrams of bytes are counted in all good texts: those whose largest quality label is 1. A hash of the text deals them into two halves,
each with a model of its own. Counts, context totals and continuation counts are tables, and the probability of every trigram that any
document asks for comes from joins of these tables, partitioned by their keys. A good text is judged by the half that lacks it, so
no text by a model that has seen it; any other text by both, by the mean of its log probabilities.

Documents meet the probabilities in shards. A task turns about BLOCK_BYTES of texts into one block: its distinct
trigrams and, for each, the documents and their counts, cut by shard of the trigram and compressed. Block parts and
model shards are cogrouped by (shard, salt); each group adds up the log probabilities of its documents' trigrams, and
the sums of a document's shards are added at the end. The number of shards follows the model. A salt takes the more documents the
larger the model is (at least one for every MODEL_ROWS of its rows), so what is sent of the model stays in proportion to the documents.
Texts and ids of good ones meet by a shuffle, whatever their number; no table is broadcast by hint.

A text is kept if its perplexity a byte is at most `slack` times the `quantile` of all good texts of its language (of all good
texts where its language has none). With `trusted` set, a single model counts a hashed sample of about so many good texts (half of them
at most), and the quantiles are those of all other good texts; a language without any takes those that it has seen.

Defined results: a null or empty text has no perplexity and is not kept; a text at its threshold is kept; a null lang is a language of
its own; equal rows get equal results, repeated ones too; a very long text is one block of its own; a half without texts makes every byte
cost the same, so that without good texts all texts with bytes are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm.common import spans, stored

BLOCK_BYTES = 1_000_000
START = b"\0\0"
CODES = 1 << 24
MODEL_ROWS = 64


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all bytes with the two before them, text after text, and the number of bytes of each text."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(x for t in texts for x in (START, t)), np.uint8).astype(np.uint32)
    codes = np.zeros(len(data), np.uint32)
    codes[2:] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    first = np.cumsum(np.concatenate(([0], sizes[:-1] + 2))).astype(np.int64)
    inside = np.ones(len(data), bool)
    inside[np.concatenate((first, first + 1))] = False
    return codes[inside], sizes


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for first, end in spans(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), BLOCK_BYTES):
        yield batch.slice(first, end - first)


def count_trigrams(texts: DataFrame, marks: Sequence[str] = ("trusted",)) -> DataFrame:
    """gram, n: every trigram of any text (data) and its count in marked ones; several marks: n_0, n_1, ..."""
    names = ["n"] if len(marks) == 1 else [f"n_{k}" for k in range(len(marks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, counts = np.zeros(CODES, bool), [np.zeros(CODES, np.uint32) for _ in marks]
        for batch in batches:
            for part in _blocks(batch, 0):
                data = [t or b"" for t in part.column(0).to_pylist()]
                asked[_trigrams(data)[0]] = True
                for k, count in enumerate(counts, 1):
                    own = part.column(k).to_pylist()
                    if any(own):
                        grams, n = np.unique(_trigrams([t for t, m in zip(data, own, strict=True) if m])[0], return_counts=True)
                        count[grams] += n.astype(np.uint32)
        found = np.nonzero(asked)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *[pa.array(c[found].astype(np.int64)) for c in counts]], ["gram", *names])

    fields = "gram int, " + ", ".join(f"{n} long" for n in names)
    return texts.select("data", *marks).mapInArrow(run, fields).groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])


def discounts(counts: DataFrame, n: str = "n") -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    found = {r[n]: r["count"] for r in counts.where(F.col(n).between(1, 4)).groupBy(n).count().collect()}
    n1, n2, n3, n4 = (found.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * more / less, 0.05), k - 0.05) for k, more, less in ((1, n2, n1), (2, n3, n2), (3, n4, n3)))


def _discounted(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n >= 3, n - d[2]).when(n == 2, n - d[1]).when(n == 1, n - d[0]).otherwise(0.0)


def _contexts(counts: DataFrame, context: str, n: str, d: tuple[float, float, float], total: str, left: str) -> DataFrame:
    """The total of each context, and the mass that discounting leaves."""
    rest = F.sum(F.when(F.col(n) >= 3, d[2]).when(F.col(n) == 2, d[1]).when(F.col(n) == 1, d[0]).otherwise(0.0))
    return counts.where(F.col(n) > 0).groupBy(context).agg(F.sum(n).alias(total), (rest / F.sum(n)).alias(left))


def probabilities(grams: DataFrame) -> DataFrame:
    """gram, logp (natural) of all asked trigrams (gram, n), by joins of counts and contexts on their keys."""
    spark = grams.sparkSession
    keyed = stored(grams.select("gram", "n", F.shiftright("gram", 8).alias("ab"), F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("bc")))
    pairs = stored(keyed.groupBy("bc").agg(F.sum((F.col("n") > 0).cast("long")).alias("after")).select("bc", "after", F.shiftright("bc", 8).alias("b"), F.col("bc").bitwiseAND(F.lit(0xFF)).alias("c")))
    singles = stored(pairs.groupBy("c").agg(F.sum((F.col("after") > 0).cast("long")).alias("kinds")))
    d3, d2, d1 = discounts(keyed), discounts(pairs, "after"), discounts(singles, "kinds")
    sums = _contexts(singles.withColumn("all", F.lit(0)), "all", "kinds", d1, "total1", "left1").first()
    total1, left1 = (sums["total1"], sums["left1"]) if sums else (1, 1.0)
    p1 = singles.select("c", (_discounted(F.col("kinds"), d1) / total1 + left1 / 256).alias("p1"))
    mixed = lambda n, d, total, left, lower: F.coalesce(_discounted(n, d) / F.col(total) + F.col(left) * lower, lower)
    p2 = (
        pairs.join(p1, "c")
        .join(_contexts(pairs, "b", "after", d2, "total2", "left2"), "b", "left")
        .select("bc", mixed(F.col("after"), d2, "total2", "left2", F.col("p1")).alias("p2"))
    )
    p3 = (
        keyed.join(p2, "bc")
        .join(_contexts(keyed, "ab", "n", d3, "total3", "left3"), "ab", "left")
        .select("gram", F.log(mixed(F.col("n"), d3, "total3", "left3", F.col("p2"))).alias("logp"))
    )
    return stored(p3)


def _packed(grams: np.ndarray, sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Distinct sorted trigrams, how many documents each has, and those documents and counts."""
    arrays = (np.diff(grams, prepend=0).astype(np.uint32), sizes.astype(np.uint32), docs.astype(np.uint32), counts.astype(np.uint32))
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return len(grams).to_bytes(8, "little") + len(docs).to_bytes(8, "little") + zstandard.compress(planes, 1)


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    g, p = int.from_bytes(payload[:8], "little"), int.from_bytes(payload[8:16], "little")
    planes, at, out = np.frombuffer(zstandard.decompress(payload[16:]), np.uint8), 0, []
    for n in (g, g, p, p):
        out.append(np.ascontiguousarray(planes[at : at + 4 * n].reshape(4, n).T).view(np.uint32).ravel())
        at += 4 * n
    return np.cumsum(out[0], dtype=np.int64), out[1], out[2], out[3]


def shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def log_probabilities(texts: DataFrame, model: DataFrame, shards: int, salts: int, mark: str = "trusted") -> DataFrame:
    """doc_id, lang, trusted (or another mark), n_bytes, logp of texts (data, trusted, doc_id, lang) with at least one byte.

    model: gram, logp; of several columns of log probabilities, each is added up under its name.
    """
    names = [c for c in model.columns if c != "gram"]
    kind = texts.schema["doc_id"].dataType.simpleString()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _blocks(batch.filter(pc.greater(pc.fill_null(pc.binary_length(batch.column(0)), 0), 0)), 0):
                codes, sizes = _trigrams(part.column(0).to_pylist())
                keys, counts = np.unique(codes.astype(np.int64) * len(part) + np.repeat(np.arange(len(part)), sizes), return_counts=True)
                grams, docs = keys // len(part), keys % len(part)
                own = shard_of(grams, shards)
                rows = []
                for k in range(shards):
                    mine = own == k
                    values, each = np.unique(grams[mine], return_counts=True)
                    rows.append(_packed(values, each, docs[mine], counts[mine]))
                repeat = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(shards + 1) * len(part), pa.int32()), pa.concat_arrays([a] * shards))
                salt = pa.array(np.full(shards, (number * 2654435761 >> 7) % salts), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(shards, number)), pa.array(np.arange(shards), pa.int32()), salt, pa.array(rows, pa.binary()), repeat(part.column(2)), repeat(part.column(3)), repeat(part.column(1)), repeat(pa.array(sizes))],
                    ["block", "shard", "salt", "payload", "ids", "langs", "marks", "sizes"],
                )
                number += 1

    fields = f"block long, shard int, salt int, payload binary, ids array<{kind}>, langs array<string>, marks array<boolean>, sizes array<long>"
    parts = texts.select("data", mark, "doc_id", "lang").mapInArrow(block, fields)
    sharded = model.withColumn("shard", _shard_column(model.sparkSession, shards)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def add(blocks: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("block", "ids", "langs", "marks", "sizes", *names)})
        table = table.sort_values("gram")
        known, logps, out = table["gram"].to_numpy(np.int64), [table[c].to_numpy() for c in names], []
        for payload, ids in zip(blocks["payload"], blocks["ids"], strict=True):
            grams, each, docs, counts = _unpacked(payload)
            at = np.searchsorted(known, grams)
            out.append([np.bincount(docs, np.repeat(logp[at] if len(grams) else np.zeros(0), each) * counts, len(ids)) for logp in logps])
        return blocks[["block", "ids", "langs", "marks", "sizes"]].assign(**{c: [sums[k] for sums in out] for k, c in enumerate(names)})

    keys = ("shard", "salt")
    sums = "".join(f", {c} array<double>" for c in names)
    summed = parts.groupBy(*keys).cogroup(sharded.groupBy(*keys)).applyInPandas(add, f"block long, ids array<{kind}>, langs array<string>, marks array<boolean>, sizes array<long>{sums}")
    rows = summed.select("block", F.posexplode(F.arrays_zip("ids", "langs", "marks", "sizes", *names)).alias("k", "x"))
    one = rows.groupBy("block", "k").agg(*[F.first(f"x.{a}").alias(b) for a, b in (("ids", "doc_id"), ("langs", "lang"), ("marks", mark), ("sizes", "n_bytes"))], *[F.sum(f"x.{c}").alias(c) for c in names])
    return one.drop("block", "k")


def _shard_column(spark: SparkSession, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(grams: pd.Series) -> pd.Series:
        return pd.Series(shard_of(grams.to_numpy(), shards).astype(np.int32))

    return of("gram")


def thresholds(good: DataFrame, quantile: float, slack: float = 1.0) -> DataFrame:
    """lang_key, threshold: slack x the quantile of the perplexities of each language (key null: of all), in steps of 2^(1/1000).

    Each task counts the steps it meets, so the exact percentile gathers counts of at most some ten thousand steps.
    """
    steps = good.select("lang_key", F.ceil(F.log2("perplexity") * 1000).alias("step"))
    limit = (slack * F.pow(F.lit(2.0), F.ceil(F.percentile("step", quantile)) / 1000)).alias("threshold")
    return steps.groupBy("lang_key").agg(limit).unionByName(steps.agg(F.lit(None).cast("string").alias("lang_key"), limit).where("threshold is not null"))


def _halves(texts: DataFrame, good: DataFrame) -> DataFrame:
    """gram, logp_0, logp_1: models of the good texts (data, doc_id, half) without and with `half`."""
    marked = texts.join(good.select(F.col("doc_id").alias("good_id")).hint("shuffle_hash"), F.col("doc_id") == F.col("good_id"), "left")
    known = F.col("good_id").isNotNull()
    counted = stored(count_trigrams(marked.select("data", (known & ~F.col("half")).alias("first"), (known & F.col("half")).alias("second")), ("first", "second")))
    one, two = (probabilities(counted.select("gram", F.col(f"n_{k}").alias("n"))).withColumnRenamed("logp", f"logp_{k}") for k in (0, 1))
    return stored(one.join(two, "gram"))


def _sample(texts: DataFrame, good: DataFrame, trusted: int) -> tuple[DataFrame, DataFrame]:
    """texts with `trusted`, whether they are of a hashed sample of about so many good ones, half of them at most; and the model of that sample."""
    fine = 1 << 30
    share = min(0.5, trusted / max(1, good.count()))
    chosen = good.where(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(fine)) < int(fine * share)).select(F.col("doc_id").alias("trusted_id"))
    # about `trusted` ids at most: the bound of this broadcast
    marked = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull())
    return marked, probabilities(count_trigrams(marked))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, slack: float = 1.0, trusted: int | None = None, shard_rows: int = 400_000, salt_docs: int = 8192) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep of every row of docs (doc_id, text, lang); labels has doc_id, quality."""
    good = stored(labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id"))
    texts = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("data"))
    if trusted is None:
        texts = texts.withColumn("half", F.pmod(F.xxhash64("data"), F.lit(2)) == 1)
        mark, model = "half", _halves(texts, good)
        unseen = F.when(F.col("half"), F.col("logp_0")).otherwise(F.col("logp_1"))
        logp, seen = F.when(F.col("good"), unseen).otherwise((F.col("logp_0") + F.col("logp_1")) / 2), F.lit(False)
    else:
        mark, (texts, model) = "trusted", _sample(texts, good, trusted)
        logp, seen = F.col("logp"), F.col("trusted")
    size = model.count()
    shards = max(4, -(-size // shard_rows))
    salts = max(1, docs.select("doc_id").count() // max(salt_docs, size // MODEL_ROWS))
    told = log_probabilities(texts, model, shards, salts, mark).join(good.withColumn("good", F.lit(True)), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    rows = stored(told.select("doc_id", "lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("?")).alias("lang_key"), F.exp(-logp / F.col("n_bytes")).alias("perplexity"), "good", seen.alias("seen")))
    new, old = (thresholds(rows.where(F.col("good") & (F.col("seen") == known)), quantile, slack) for known in (False, True))
    limits = stored(new.unionByName(old.join(new.select(F.coalesce("lang_key", F.lit("")).alias("told")), F.coalesce("lang_key", F.lit("")) == F.col("told"), "left_anti")))
    every = limits.where("lang_key is null").first()
    overall = F.lit(every["threshold"] if every else float("inf"))
    judged = rows.join(limits.where("lang_key is not null"), "lang_key", "left").select("doc_id", "lang", "perplexity", F.coalesce("threshold", overall).alias("threshold"))
    empty = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) == 0).select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"))
    return judged.unionByName(empty).withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
