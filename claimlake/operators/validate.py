"""Validators: each gives the rows that break a rule."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.operators.beside import beside_text, checked, exact


def span_bounds(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """spans (source_hash, byte_start, byte_end) against sources (source_hash, size)."""
    s = sources.select("source_hash", "size").distinct()
    start, end = (F.expr(f"try_cast({c} as bigint)") for c in ("byte_start", "byte_end"))
    reason = (
        F.when(F.col("size").isNull(), "unknown_source")
        .when(start.isNull() | end.isNull(), "not_an_integer")
        .when((start < 0) | (end < 0) | (end < start), "invalid_range")
        .when(end > F.col("size"), "beyond_source")
    )
    return spans.join(s, "source_hash", "left").withColumn("reason", reason).where("reason is not null").select("source_hash", "byte_start", "byte_end", "reason")


def evidence(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Each candidate (doc_id, evidence, byte_start, byte_end) with ok, and n_found: 0, 1 or 2 for ambiguous."""
    result = [("ok", "boolean", pa.bool_()), ("n_found", "int", pa.int32())]
    return beside_text(candidates, docs, ["evidence", "byte_start", "byte_end"], result, checked)


def byte_exact_evidence(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Each candidate with ok: whether its evidence is what lies at its bytes. Nothing is searched for."""
    return beside_text(candidates, docs, ["evidence", "byte_start", "byte_end"], [("ok", "boolean", pa.bool_())], exact)


def evidence_report(checked: DataFrame) -> DataFrame:
    n = F.count("*")
    rate = lambda x: F.bround(F.coalesce(F.try_divide(x, n), F.lit(0.0)), 4)
    good, twice = F.count_if("ok"), F.count_if(F.col("n_found") > 1)
    return checked.agg(n.alias("validated"), (n - good).alias("dropped"), twice.alias("ambiguous"), rate(n - good).alias("drop_rate"), rate(twice).alias("ambiguity_rate"))


def text_spans(spans: DataFrame) -> DataFrame:
    """Spans (start, end, n_chars) that do not lie in their text."""
    return spans.where("start < 0 or end < start or end > n_chars")


def claim_rows(claims: DataFrame) -> DataFrame:
    """n-ary claims without an id, a predicate, a subject argument or a source span."""
    reason = (
        F.when(F.coalesce("claim_id", F.lit("")) == "", "no_claim_id")
        .when(F.coalesce("predicate", F.lit("")) == "", "no_predicate")
        .when(~F.exists("args", lambda a: a["role"] == "subject"), "no_subject")
        .when(F.size("source_spans") <= 0, "no_span")
    )
    return claims.withColumn("reason", reason).where("reason is not null").select("claim_id", "reason")


def duplicates(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(table: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return table.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def nulls(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, n: columns that must not be null and are."""
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n").where("n > 0")


def stream_gaps(events: DataFrame, key: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Places where a stream's sequence does not go up by one."""
    order = Window.partitionBy(key).orderBy(seq)
    return events.withColumn("previous", F.lag(seq).over(order)).where(F.col("previous").isNotNull() & (F.col(seq) != F.col("previous") + 1)).select(key, "previous", seq)


def broken_chain(events: DataFrame, key: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Events (hash, prev_hash) that do not name the hash of the one before, or whose hash is not that of their
    payload."""
    order = Window.partitionBy(key).orderBy(seq)
    before = F.lag("hash").over(order)
    own = F.sha2(F.concat_ws("\x1f", "prev_hash", "payload"), 256)
    return events.withColumns({"_before": before, "_own": own}).where((F.col("_before").isNotNull() & (F.col("_before") != F.col("prev_hash"))) | (F.col("_own") != F.col("hash"))).select(key, seq)
