"""The log of answered questions, as candidates for a shard of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.functions.scalar import summary

SCHEMA = (
    "interaction_id string, ts double, query string, answer string, citations array<struct<claim_id string, id string, shard_id string, subject string, subject_label string, predicate string, object string, object_label string>>, session_id string, metadata map<string, string>"
)


def candidates(log: DataFrame, min_citations: int = 1, max_records: int | None = None, most: int = 10) -> DataFrame:
    """Each interaction with enough citations: the question was answered by a summary, and cites up to ``most`` claims.
    ``max_records`` takes the latest of the log."""
    if max_records:
        log = log.orderBy(F.desc("ts"), F.desc("interaction_id")).limit(max_records)
    kept = log.where(F.size(F.coalesce("citations", F.array())) >= min_citations)
    subject = F.concat(F.lit("query:"), F.coalesce("interaction_id", F.lit("unknown")))
    answered = kept.select(
        subject.alias("subject"), F.lit("was_answered_by").alias("predicate"), summary(F.col("answer")).alias("object"), F.lit("literal:string").alias("object_type"), F.col("query").alias("evidence"), F.lit(None).cast("string").alias("source_shard"), F.lit(-1).alias("pos")
    )
    cited = kept.select("interaction_id", F.posexplode(F.slice("citations", 1, most)).alias("pos", "c"))
    one = lambda *names: F.coalesce(*[F.nullif(F.col(f"c.{n}"), F.lit("")) for n in names])
    text = F.concat_ws(" → ", F.coalesce(one("subject", "subject_label"), F.lit("")), F.coalesce(one("predicate"), F.lit("cited_by")), F.coalesce(one("object", "object_label"), F.lit("")))
    cites = cited.select(subject.alias("subject"), F.lit("cites_claim").alias("predicate"), one("claim_id", "id").alias("object"), F.lit("entity").alias("object_type"), text.alias("evidence"), F.coalesce("c.shard_id", F.lit("")).alias("source_shard"), "pos").where("object is not null")
    return answered.unionByName(cites).withColumns({"tier": F.lit(0), "confidence": F.lit(1.0)})


def report(log: DataFrame, min_citations: int = 1) -> DataFrame:
    enough = F.size(F.coalesce("citations", F.array())) >= min_citations
    return log.agg(F.count("*").alias("total"), F.count_if(~enough).alias("skipped_uncited"))
