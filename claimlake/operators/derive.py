"""Derived extensions: temporal, coordinates, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.functions.scalar import MAJOR_NAMES, TYPE_NAMES, coordinates, extract_date, is_temporal
from claimlake.operators.prefix import running


def temporal(claims: DataFrame) -> DataFrame:
    """claim_id, valid_from, valid_until, temporal_context of claims that speak of time."""
    t = claims.where(is_temporal(F.col("predicate"), F.col("object")))
    found = F.coalesce(extract_date(F.col("object")), F.lit(""))
    return t.select("claim_id", found.alias("valid_from"), F.lit("").alias("valid_until"), F.concat_ws(": ", "predicate", "object").alias("temporal_context"))


def coords(entities: DataFrame) -> DataFrame:
    """entity_id, major, type, subtype, instance. Instances count up within a coordinate by entity_id, by ranges of both, so a
    frequent coordinate is never one task's whatever its ids look like."""
    at = entities.select("entity_id", "label", coordinates(F.col("label")).alias("at")).select("entity_id", "label", "at.*", F.lit(1).alias("one"))
    out = running(at, "one", ["entity_id", "label"], ("major", "type", "subtype"))
    instance = F.format_string("%02d-%02d-%02d-%04d", "major", "type", "subtype", (F.col("before") + 1).cast("long"))
    return out.select("entity_id", "label", "major", "type", "subtype", instance.alias("instance"))


def coordinate_names(at: DataFrame) -> DataFrame:
    majors = F.create_map(*[F.lit(x) for pair in MAJOR_NAMES.items() for x in pair])
    kinds = F.create_map(*[F.lit(x) for (m, t), name in TYPE_NAMES.items() for x in (m * 100 + t, name)])
    return at.withColumns(
        {
            "major_name": F.coalesce(F.try_element_at(majors, F.col("major")), F.col("major").cast("string")),
            "type_name": F.coalesce(F.try_element_at(kinds, F.col("major") * 100 + F.col("type")), F.col("type").cast("string")),
        }
    )


def confidence_summary(candidates: DataFrame) -> DataFrame:
    """tier (null: all), n, mean, least, most; a missing tier is 3, a missing confidence 0.7."""
    c = candidates.select(F.coalesce("tier", F.lit(3)).alias("tier"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"))
    r = lambda x: F.bround(x, 4)
    return c.rollup("tier").agg(F.count("*").alias("n"), r(F.avg("confidence")).alias("mean"), r(F.min("confidence")).alias("least"), r(F.max("confidence")).alias("most"))


def top_predicates(claims: DataFrame, most: int = 20) -> DataFrame:
    return claims.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(most)
