"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import ann, bpe, decontaminate, kneser_ney, langid, lm_score, merkle, pii, token_files, toxicity, wand
from foldloom.llm.common import PLAIN_READS, remainder, table
from foldloom.llm.sharding import shard_documents
from foldloom.llm.simhash import near_duplicates


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    trees = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(trees, docs.select("doc_id", "held_out", "text"), F.col("text")).drop("text")


def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return lm_score.scored(table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out")))


def op6_compression_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = toxicity.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", "held_out", toxicity.score(model, docs, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(vocabulary))
    return bpe.digests(bpe.tokenized(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op10_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(wand.build_index(table(spark, sf_dir, "documents", **PLAIN_READS)), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json", end: int = 2) -> DataFrame:
    return token_files.digests(token_files.written(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), end))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jump_shards, op2_simhash_near_dedup, op3_kneser_ney_quality, op4_ppm_language_id, op5_backoff_automaton, op6_compression_toxicity, op7_byte_bpe, op8_positional_index, op9_feistel_pseudonyms, op10_kmeans_tree_neighbours, op11_merkle_manifest, op12_wand_search, op13_token_files)}
OP8_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
v as (select item_id, len(w) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as s, w from b where len(w) > 0),
windows as (select distinct item_id, least(n, 10) as k, list_slice(w, s, s + least(n, 10) - 1) as words from v),
p as (select doc_id, k, pos, list_slice(w, pos, pos + k - 1) as words from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from d), (select distinct k from windows)),
found as (select p.doc_id, p.pos, x.item_id, x.k from windows x join p on p.k = x.k and p.words = x.words),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + k)) as place from found) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join ids using (doc_id)
"""

#: crc: table of the CRC-32 of single bytes; lv: all nodes of the source trees, tv: of the upper tree; a source s is '' for null, else = and its name
OP11_SQL = r"""
with recursive crc_(b, k, c) as (select range, 0, range from range(256) union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_ where k < 8),
crc as (select list(c order by b) as t from crc_ where k = 8),
l as (select doc_id, coalesce('=' || source, '') as s, text, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ord(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) as r from documents, crc),
d as (select doc_id, s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(case when r & 1 = 1 then replace(text, chr(10), '') else text end) || ':' || case when r & 1 = 1 then replace(text, chr(10), '') else text end, '-')) as changed from l),
p as (select *, row_number() over (partition by s order by doc_id, leaf) - 1 as i, count(*) over (partition by s) as n from d),
lv(level, s, i, h, n) as (select 0, s, i, leaf, n from p union all select level + 1, s, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from lv where n > 1 group by level, s, i // 3),
sub as (select s, h, level as levels, row_number() over (order by s) - 1 as i, count(*) over () as n from lv where n = 1),
tv(level, i, h, n) as (select 0, i, h, n from sub union all select level + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from tv where n > 1 group by level, i // 3),
run as (select level, s, i // 3 as g, list(h order by i) as hs from lv where n > 1 group by all union all select sub.levels + level, sub.s, tv.i // 3, list(tv.h order by tv.i) from tv join sub on tv.n > 1 and tv.i // 3 = (sub.i // cast(pow(3, level) as bigint)) // 3 group by all),
walk(doc_id, s, level, i, leaf, held, sibs) as (select doc_id, p.s, 0, case when levels = 0 then sub.i else p.i end, leaf, changed, '' from p join sub on sub.s = p.s union all
select w.doc_id, w.s, w.level + 1, case when w.level + 1 = sub.levels then sub.i else w.i // 3 end, w.leaf, sha256(array_to_string(list_concat(hs[1:(w.i % 3)], [w.held], hs[(w.i % 3 + 2):]), '')), w.sibs || array_to_string(list_concat(hs[1:(w.i % 3)], hs[(w.i % 3 + 2):]), '')
from walk w join sub on sub.s = w.s join run on run.level = w.level and run.s = w.s and run.g = w.i // 3)
select w.doc_id, w.leaf, sub.h as subroot, tv.h as root, sha256(sibs) as proof_sha256, held as folded_root, held = tv.h as verified
from walk w join sub on sub.s = w.s join tv on tv.n = 1 where w.level = sub.levels + tv.level
"""

OP12_SQL = r"""
with words as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
d as (select row_number() over () as row, doc_id, w, len(w)::bigint as n from words where len(w) > 0),
q as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
asked as (select distinct item_id, unnest(w) as term from q),
total as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from d),
tf as (select row, doc_id, n, term, count(*)::bigint as tf from (select row, doc_id, n, unnest(w) as term from d) where term in (select term from asked) group by all),
weight as (select term, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)))::bigint as weight from tf, total group by term),
scored as (select item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::bigint as score from asked join tf using (term) join weight using (term), total group by item_id, row, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50
"""

ORACLES: dict[str, str] = {"op12_wand_search": OP12_SQL, "op8_positional_index": OP8_SQL, "op11_merkle_manifest": OP11_SQL}
