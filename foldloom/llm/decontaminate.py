"""Benchmark decontamination with a distributed positional inverted index.

`build_index` stores the postings (document, term, position) of every occurrence of a benchmark term in the training
texts, and one end posting a document that carries its number of words. `phrase_hits` answers all benchmark windows at
once. Each window names its rarest terms by their number of postings. Their lists, adjusted by each term's offset in the item, are
intersected first: an alignment (document, item, shift) stays only if some window has all its rarest terms there. Then
the lists of all other item terms join the few alignments left, and runs of matching positions give exact hits.
`proximity_hits` returns where the two rarest terms of an item stand within a distance. DataFrame functions only.

Documents are told apart by doc_id and text, so rows that repeat a doc_id keep their own results, and equal rows each
get the same one. Defined results: a null or wordless text has no words and no hits; a null or wordless item has no
windows; items that share an item_id count once; a null item_id hits words and counts as one item, but has no place in
the digest; empty tables give no hits; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.common import ascii_lower, small, stored

#: what stands between words, once A-Z are lower-case
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = ""
DOC = ["doc_id", "text_hash"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # doc_id, text_hash, term, pos
    documents: DataFrame  # doc_id, text_hash, n_words; one row a document row
    items: DataFrame  # item, item_id, length, ipos, term


def build_index(docs: DataFrame, benchmark: DataFrame) -> Index:
    """Store the postings of benchmark terms in docs (doc_id, text); benchmark has item_id, text."""
    listed = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    named = stored(listed.withColumn("item", F.monotonically_increasing_id()))
    exploded = named.select("item", "item_id", F.size("words").alias("length"), F.posexplode("words").alias("ipos", "word"))
    end = docs.sparkSession.range(1).select(F.lit(END).alias("word"))
    vocabulary = stored(exploded.select("word").unionByName(end).distinct().withColumn("term", F.when(F.col("word") == END, -1).otherwise(F.monotonically_increasing_id())))
    lookup = small(vocabulary)
    items = stored(exploded.join(lookup, "word").drop("word"))
    told = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(words(F.col("text")), F.array(F.lit(END))).alias("words"))
    postings = stored(told.select(*DOC, F.posexplode("words").alias("pos", "word")).join(lookup, "word").select(*DOC, "term", "pos"))
    documents = postings.where("term = -1").select(*DOC, F.col("pos").cast("long").alias("n_words"))
    return Index(postings.where("term >= 0"), documents, items)


def _same(left: DataFrame, right: DataFrame, *more: str) -> Column:
    """Equal documents (a null doc_id equals itself) and equal further columns."""
    on = left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])
    for name in more:
        on &= left[name] == right[name]
    return on


def _rare_terms(index: Index, width: int, n_terms: int) -> DataFrame:
    """item, start, ipos, term of the rarest terms of each window that can occur at all."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    counted = stored(index.items.join(counts, "term", "left").select("item", "ipos", "term", "n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("length") - width, F.lit(0)))
    windows = index.items.select("item", "length").distinct().select("item", F.explode(starts).alias("start"))
    inside = windows.join(counted, "item").where(f"ipos between start and start + {width - 1}")
    per = Window.partitionBy("item", "start")
    ranked = inside.withColumns({"rank": F.row_number().over(per.orderBy("n", "ipos")), "lost": F.max(F.col("n").isNull()).over(per)})
    return ranked.where(f"rank <= {n_terms} and not lost").select("item", "start", "ipos", "term")


def phrase_hits(index: Index, width: int = 10, n_terms: int = 3) -> DataFrame:
    """doc_id, text_hash, item_id, first, last: stretches of document words inside occurring windows."""
    rare = stored(_rare_terms(index, width, n_terms))
    anchors = small(rare.select("item", "ipos", "term").distinct())
    shifted = index.postings.join(anchors, "term").select(*DOC, "item", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
    held = shifted.groupBy(*DOC, "item", "shift").agg(F.collect_set("ipos").alias("held"))
    needs = rare.groupBy("item", "start").agg(F.collect_set("ipos").alias("need")).groupBy("item").agg(F.collect_set("need").alias("needs"))
    met = F.exists("needs", lambda need: F.size(F.array_except(need, F.col("held"))) == 0)
    aligned = stored(held.join(small(needs), "item").where(met).select(*DOC, "item", "shift"))
    wanted = aligned.join(small(index.items), "item").withColumn("pos", F.col("shift") + F.col("ipos"))
    # the lists of all terms, but of the few documents that have an alignment
    suspects = small(stored(aligned.select(*DOC).distinct()))
    lists = index.postings.join(suspects, _same(index.postings, suspects), "left_semi")
    matched = lists.join(wanted, _same(lists, wanted, "term", "pos"), "left_semi").distinct()
    found = wanted.join(matched, _same(wanted, matched, "term", "pos"), "left_semi")
    runs = found.groupBy(*DOC, "item", "item_id", "shift", "length").agg(F.sort_array(F.collect_set("ipos")).alias("run"))
    size = F.least(F.col("length"), F.lit(width))
    begins = F.filter(F.transform("run", lambda x, i: F.when(F.get("run", i + size - 1) == x + size - 1, x)), lambda x: x.isNotNull())
    return runs.select(*DOC, "item_id", "shift", size.alias("size"), F.explode(begins).alias("start")).select(
        *DOC, "item_id", (F.col("shift") + F.col("start")).alias("first"), (F.col("shift") + F.col("start") + F.col("size") - 1).alias("last")
    )


def proximity_hits(index: Index, within: int = 20) -> DataFrame:
    """doc_id, text_hash, item_id, first, last: places where an item's two rarest terms stand at most `within` words apart."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    distinct = index.items.select("item", "item_id", "term").distinct().join(counts, "term")
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("n", "term"))).where("rank <= 2")
    placed = index.postings.join(small(stored(ranked)), "term").distinct()
    before = Window.partitionBy(*DOC, "item", "item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("rank") == k, F.col("pos")), ignorenulls=True).over(before) for k in (1, 2)}
    other = F.when(F.col("rank") == 1, last[2]).otherwise(last[1])
    return placed.withColumn("first", other).where(F.col("pos") - F.col("first") <= within).select(*DOC, "item_id", "first", F.col("pos").alias("last"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    index = build_index(docs, benchmark)
    hits = stored(phrase_hits(index, width))
    # joined stretches: a stretch counts the words past the last end before it
    before = Window.partitionBy(*DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1))), F.lit(0))
    counted = hits.select(*DOC, "first", "last").distinct().withColumn("fresh", fresh).groupBy(*DOC).agg(F.sum("fresh").alias("n_hit"))
    listed = hits.select(*DOC, "item_id").distinct().groupBy(*DOC).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    both = counted.join(listed, _same(counted, listed)).select(counted["doc_id"].alias("hit_id"), counted["text_hash"].alias("hit_hash"), "n_hit", "n_items", "ids")
    every = index.documents
    return every.join(both, every["doc_id"].eqNullSafe(both["hit_id"]) & (every["text_hash"] == both["hit_hash"]), "left").select(
        *DOC,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs without any benchmark window."""
    hits = small(stored(phrase_hits(build_index(docs, benchmark), width).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()))
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["hit_id"]) & (F.xxhash64(docs["text"]) == hits["hit_hash"]), "left_anti")
