"""The corpus pipeline: language identification, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's rows
to the shared folder and rereads them. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import langid
from claimlake.llm.common import documents, held_out, table
from claimlake.llm.exact_dedup import exact_duplicates
from claimlake.llm.mixing import mixed
from claimlake.llm.near_dedup import near_duplicates
from claimlake.llm.packing import packed
from claimlake.runtime import ready


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects: null, without a letter, or far from every language. Rows repeated
    under one id are judged each for itself, equal texts alike (of languages equally near the first by name is taken), texts of any length whole; a table without a labelled
    row keeps none, an empty one is empty; other columns stay as they are."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.where(~langid.classify(F.col("text"), model, spark)["rejected"])


#: Up to so many dropped documents are broadcast to the texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` (column of ``gone``: expression over ``docs``) are not in it. What goes is less
    than what stays, and texts that meet it by broadcast are not shuffled again."""
    gone = table(gone.select(*[F.col(k).alias(f"claimlake_{k}") for k in keys]).distinct(), "gone")
    same = [expression.eqNullSafe(F.col(f"claimlake_{k}")) for k, expression in keys.items()]
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, reduce(and_, same), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the smallest id, null the last; of rows repeated under that id one.
    Null and empty texts are equal; texts of any length are held whole. An empty table stays empty; other columns stay
    as they are, of repeated rows those of any one."""
    verdicts = table(exact_duplicates(docs).select("doc_id", "kept", F.col("text_sha256").alias("sha")), "verdicts")
    text, sha = F.coalesce(F.col("text").cast("binary"), F.lit(b"")), "claimlake_text_sha"
    docs = docs.withColumn(sha, F.sha2(text, 256))
    kept = _without(docs, verdicts.where("not kept"), doc_id=F.col("doc_id"), sha=F.col(sha))
    again = table(verdicts.where("kept").groupBy("doc_id", "sha").count().where("count > 1").select("doc_id", "sha"), "again")
    if not again.isEmpty():
        once = _without(kept, again, doc_id=F.col("doc_id"), sha=F.col(sha))
        same = kept["doc_id"].eqNullSafe(again["doc_id"]) & (kept[sha] == again["sha"])
        kept = once.union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", sha]))
    return kept.drop(sha)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, with all rows under that id. Rows
    without an id are linked with nothing and stay, as do texts without words. Texts of any length are taken whole; an
    empty table stays empty; other columns stay as they are."""
    return _without(docs, near_duplicates(docs).where("not kept"), doc_id=F.col("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for. A null source is one of its own; null and empty texts
    have size 0, very long ones the size of their whole text; rows repeated under one id share their coin; an empty table stays
    empty; columns stay as they are."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a document that the mixture repeats is packed each time. Null counts as empty,
    texts of any length are cut without loss, an empty table gives no sequence; other columns are not looked at."""
    return packed(docs)


def _stage(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda spark, docs, sf_dir: fn(ready(spark), docs, sf_dir)


STAGES = [(name, _stage(fn)) for name, fn in (("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack))]

#: Hashed n-grams, min-hashes and token ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
