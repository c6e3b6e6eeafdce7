"""One query for each operator, applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import filter_audit, langid, mixing, oracles, packing, quality_classifier, quality_rules, token_counts, token_output
from claimlake.llm.common import documents
from claimlake.llm.exact_dedup import exact_duplicates
from claimlake.llm.near_dedup import near_duplicates
from claimlake.llm.sharding import document_shards
from claimlake.llm.simhash import simhash_duplicates
from claimlake.llm.spelling import spelling_variants


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(documents(spark, sf_dir))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows, with the checksums of their id and position vectors in place of the vectors."""
    packed = token_output.packed_ids(documents(spark, sf_dir))
    digests = {"ids_crc32": F.crc32("input_ids"), "positions_crc32": F.crc32("position_ids")}
    return packed.withColumns(digests).drop("input_ids", "position_ids")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces, with the checksums of their ids in place of the ids."""
    return packing.packed(documents(spark, sf_dir)).drop("ids")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op2 that SQL can say too."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7's law fixes of each shard: its rows, its slots, and the sizes of all."""
    shards = op7_sharding(spark, sf_dir)
    law = shards.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("n_slots"))
    return law.crossJoin(F.broadcast(shards.agg(F.sum("size").alias("bytes"))))  # one row


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs, with the checksums of their ids in place of the ids."""
    return corpus_pipeline.run(spark, sf_dir).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality_rules,
        op3_token_counts,
        op4_quality_classifier,
        op5_minhash_near_dedup,
        op6_exact_dedup,
        op7_sharding,
        op8_token_output,
        op9_source_mixing,
        op10_best_fit_packing,
        op11_simhash_near_dedup,
        op12_filter_audit,
        op13_spelling_variants,
        rules_base,
        shard_law,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op5_minhash_near_dedup": """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), starts as (
  select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from words where len(ws) > 0
), shingles as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from starts
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), ways as (
  select a, b from links union all select b, a from links
), reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, w.b from reach r join ways w on w.a = r.other
), home as (
  select doc_id, min(other) as component_id from reach group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join home h on h.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id""",
    "rules_base": """
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents
), windows as (
  select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from t where len(ws) >= 8)
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from windows) where c > 1
), covered as (
  select doc_id, count(distinct i + k) as n from twice, (select unnest(range(8)) as k) group by doc_id
), counts as (
  select t.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from t left join covered c on c.doc_id = t.doc_id
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts""",
    "shard_law": """
with n as (select count(*) as n, sum(coalesce(strlen(text), 0) + 16)::bigint as bytes from documents), shards as (select k::int as shard, n // 40 + (k < n % 40)::int as n, bytes from n, (select unnest(range(40)) as k))
select shard, n::bigint as n, 0::bigint as first, (n - 1)::bigint as last, n::bigint as n_slots, bytes from shards where n > 0""",
    "op6_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
    "op9_source_mixing": mixing.ORACLE,
    "op11_simhash_near_dedup": oracles.SIMHASH,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_spelling_variants": oracles.SPELLING,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
