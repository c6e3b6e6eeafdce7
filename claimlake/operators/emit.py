"""n-ary claims to candidates, and candidates to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.operators import derive


def from_args(claims: DataFrame) -> DataFrame:
    """claims (predicate, args array<struct<role, entity_id>>, value, snippets array<string>) -> candidates of those with
    evidence, a subject and a predicate; the object is the value, else the object argument."""
    of = lambda role: F.try_element_at(F.filter("args", lambda a: a["role"] == role), F.lit(-1))["entity_id"]
    value = F.col("value").cast("string")
    df = claims.select(of("subject").alias("subject"), "predicate", F.coalesce(value, of("object")).alias("object"), F.when(value.isNull(), "entity").otherwise("literal:string").alias("object_type"), F.try_element_at("snippets", F.lit(1)).alias("evidence"))
    return df.where("coalesce(subject, '') <> '' and coalesce(predicate, '') <> '' and coalesce(evidence, '') <> ''")


def candidates_to_json(candidates: DataFrame, path: str) -> None:
    candidates.write.mode("overwrite").json(path)


def extension_to_parquet(df: DataFrame, path: str, keys: list[str]) -> None:
    """Sorted by key, so that row groups can be skipped."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def confidence_report(candidates: DataFrame) -> dict:
    """Summary by tier and the most frequent predicates, as a small dictionary."""
    rows = derive.confidence_summary(candidates).orderBy(F.col("tier").asc_nulls_first()).collect()
    named = {("all" if r["tier"] is None else str(r["tier"])): {"n": r["n"], "mean": r["mean"], "least": r["least"], "most": r["most"]} for r in rows}
    return {"tiers": named, "predicates": {r["predicate"]: r["n"] for r in derive.top_predicates(candidates).collect()}}
