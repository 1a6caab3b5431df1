"""Token ids in ORC files, written in order of doc_id and read back by stripes.

Texts are range-partitioned by doc_id, and each task encodes its sorted rows with a given tokenizer and writes one file: rows
of doc_id, the file's number, the number of ids before the row in its file, and the ids. ORC writes integers by run lengths, keeps
minima and maxima of each stripe and of each `stride` rows in its row index, and a Bloom filter on doc_id beside them, so a search for
few documents skips stripes and row groups by their metadata alone, and readers may take stripes in any order: where a document starts
follows from the sums of the files before its own, one row a file.

The tokenizer drops white space, and nothing it does reaches across ASCII white space (its splits don't, and neither does composition of
characters), so a text is cut there and each distinct word is encoded once by the tokenizers library; words met are remembered up to
a bound. A very long text is cut into parts of a megabyte at white space.

Defined results: a null or empty text has no ids but the end; null doc_ids come first; rows that repeat a doc_id come in order of a hash of their
texts, equal rows one after the other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldloom.llm.common import new_folder, pieces, small, spans, stored

#: words of at most so many bytes are remembered, and twice so many of them at most
LONGEST, REMEMBERED = 64, 300_000
CHUNK_BYTES = 8_000_000
STOPS = ",.;:!?"
#: words of Latin letters whose small form is one letter, too, and which composition leaves as they are
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
LATIN = re.compile(LETTERS)
#: fixed values: the characters that stand for bytes in byte-level vocabularies; those that print stand for themselves
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: b for b in SHOWN} | {b: 0x100 + k for k, b in enumerate(sorted(set(range(0x100)) - set(SHOWN)))}


class Remembered(dict):
    """What a function gives for a key. When it is full, what was asked for lately stays for another round."""

    def __init__(self, made: Callable[[str], bytes], most: int = REMEMBERED):
        super().__init__()
        self.made, self.most, self.older = made, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Ids of texts (UTF-8), packed as little-endian 32-bit integers."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.parts = Remembered(self._part)

    def _part(self, part: str) -> bytes:
        """A word of small Latin letters is one piece for the tokenizer's model, which wants its bytes as characters; all else goes to the tokenizer."""
        if LATIN.match(part):
            return array("i", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(BYTES))]).tobytes()
        return array("i", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def split(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words of letters in small letters, and the stops after them; other words as they are, and nothing after them.

        The tokenizer lowers cases, and ends a run of letters before a stop, so the ids of a word are those of both parts.
        """
        bare = pc.utf8_rtrim(words, characters=STOPS)
        plain = pc.match_substring_regex(bare, LETTERS)
        ended = pc.and_(plain, pc.less(pc.binary_length(bare), pc.binary_length(words)))
        stops = pc.replace_substring_regex(words.filter(ended), rf"^.*[^{STOPS}]", "")
        return pc.if_else(plain, pc.utf8_lower(bare), words), pc.replace_with_mask(pa.array([""] * len(words)), ended, stops)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and their number in each; each distinct word is looked up once."""
        cut = pc.ascii_split_whitespace(texts)
        words = cut.values.dictionary_encode()
        parts = pa.concat_arrays(self.split(words.dictionary)).dictionary_encode()
        packed = list(map(self.parts.__getitem__, parts.dictionary.to_pylist()))
        sizes = np.array([len(p) >> 2 for p in packed], np.int64)
        flat, starts = np.frombuffer(b"".join(packed), "<i4"), np.cumsum(sizes) - sizes
        codes = parts.indices.to_numpy().reshape(2, -1).T[words.indices.to_numpy()].ravel()  # of each word's two parts, in turn
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], each)]
        return ids, np.diff(ends[2 * cut.offsets.to_numpy()])

    def whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of any length: in stretches of CHUNK_BYTES, longer texts in parts of a megabyte."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        sizes = pc.binary_length(texts).to_pylist()
        for first, end in spans(sizes, CHUNK_BYTES):
            if max(sizes[first:end]) <= CHUNK_BYTES:
                own, n = self.encode(texts[first:end])
                ids.append(own)
                counts.append(n)
                continue
            for text in texts[first:end]:
                parts = [self.encode(pa.array([part.decode()]))[0] for part in pieces(text.as_py().encode())]
                ids += parts
                counts.append(np.array([sum(map(len, parts))]))
        return np.concatenate(ids), np.concatenate(counts)


@lru_cache(maxsize=1)
def _encoder(definition: str) -> WordEncoder:
    """One encoder a worker process, with the words that its tasks have met."""
    return WordEncoder(definition)


@dataclass(frozen=True)
class TokenFiles:
    """ORC files of doc_id, part, first and ids, in order of part and first."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        return self.spark.read.orc(self.path)

    def documents(self, doc_ids: Sequence[int]) -> DataFrame:
        """Rows of a few documents; the condition reaches the stripes' statistics, row indexes and Bloom filters."""
        return self.read().where(F.col("doc_id").isin(*doc_ids))

    def starts(self) -> DataFrame:
        """part and start: the number of ids in all files before it; one row a file."""
        totals = self.read().groupBy("part").agg(F.sum(F.size("ids")).alias("count"))
        return _before(totals)


def _before(totals: DataFrame) -> DataFrame:
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("start"))


def write(docs: DataFrame, path: str, definition: str, end: int, stripe_bytes: int = 16 << 20, stride: int = 1000) -> TokenFiles:
    """Write the ids of docs (doc_id, text), each document followed by the id `end`. definition: the tokenizer's JSON text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)  # a file of fixed size
    by = ["doc_id", "hash_", "tie_"]
    told = docs.select("doc_id", "text", F.xxhash64("text").alias("hash_"), F.monotonically_increasing_id().alias("tie_"))
    ordered = told.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = _encoder(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in spans(sizes, CHUNK_BYTES):
                rows = batch.slice(a, b - a)
                ids, counts = encoder.whole(pc.fill_null(rows.column(1), ""))
                ids = np.insert(ids, np.cumsum(counts), end)
                ends = np.concatenate([[0], np.cumsum(counts + 1)])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(first + ends[:-1]), listed], ["doc_id", "part", "first", "ids"])
                first += int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    options = {"orc.bloom.filter.columns": "doc_id", "orc.create.index": "true", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": stride, "compression": "zstd"}
    ordered.mapInArrow(encode, f"doc_id {kind}, part int, first long, ids array<int>").write.options(**options).orc(path)
    return TokenFiles(spark, path)


def digests(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from its files."""
    rows = files.read()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    told = stored(rows.select("doc_id", "part", "first", "ids").mapInArrow(sum_up, f"doc_id {kind}, part int, first long, n_tokens long, ids_crc32 long"))
    starts = _before(told.groupBy("part").agg(F.sum("n_tokens").alias("count")))
    return told.join(small(stored(starts)), "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str, end: int) -> TokenFiles:
    """docs in new files of the shared folder. tokenizer: the path of its JSON file, read once, by the driver."""
    with open(tokenizer, encoding="utf-8") as file:
        return write(docs, new_folder(docs.sparkSession, "tokens"), file.read(), end)
