"""A cleaning pipeline over documents: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import bpe, decontaminate, langid, pii, simhash
from foldloom.llm.common import discard, long_texts, table, temporary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: code length of noise is near eight bits a byte; text of a learned language lies far below, but a few rare bytes weigh in a short one
MOST_BITS_PER_BYTE, RARE_BITS = 7.0, 32
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a learned language: no `und`, and fewer bits than noise takes. lang becomes the prediction.

    Null and empty texts, and those without a letter, go; ties go to the first language in order; equal rows share a fate; a very long text is
    judged whole; without any labelled text nothing is learned and nothing stays.
    """
    long_texts(spark)
    docs = docs.select(*COLUMNS)
    found = langid.predict(langid.fit(docs), docs, F.col("text"))
    noise = MOST_BITS_PER_BYTE + RARE_BITS / F.greatest(F.octet_length("text"), F.lit(1))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") <= noise))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each component of near copies.

    Null and wordless texts have fingerprint zero and count as copies of each other; a null doc_id comes last; of equal rows one stays; a very
    long text is fingerprinted whole.
    """
    long_texts(spark)
    return simhash.deduplicated(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without any ten-word window of a benchmark item.

    Null and empty texts stay, as do all where the benchmark is empty; equal rows share a fate; rows of one doc_id are judged by their own texts.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the text.

    Null and empty texts stay as they are; equal values, and so equal rows, get equal pseudonyms.
    """
    return pii.pseudonymized(docs.select(*COLUMNS), pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of ids and of the decoded bytes.

    Null and empty texts have no tokens; every row, repeated ones too, gives one row; an empty table gives none.
    """
    long_texts(spark)
    tokens = bpe.tokenized(docs, bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    return bpe.digests(tokens)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("feistel_pseudonyms", pseudonyms),
    ("byte_bpe", byte_bpe),
]

#: language ID, fingerprints and BPE have no SQL form
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with temporary(spark) as kept:
            after = kept(stage(spark, docs, sf_dir))
        discard(docs)  # does nothing to the input, which is no stored table
        docs = after
    return docs
