"""Labels for entity ids, and the chain from a claim to the bytes that prove it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of an object that go with its claim's id.
SHORT = 64


def object_label(object_type, label, obj):
    """An entity object reads as its label, a literal as itself."""
    return F.when(object_type == "entity", label).otherwise(obj)


def claims_resolved(claims: DataFrame, entities: DataFrame, *, strict: bool = False) -> DataFrame:
    """Claims with ``subject`` and ``object`` as labels and the ids beside them. An id without an entity stays as it
    is, or, ``strict``, an unknown subject drops the claim and an unknown object reads null. Joins are equi-joins on
    entity_id: AQE broadcasts entities while they are small and splits a hot subject beyond that."""
    names = entities.groupBy("entity_id").agg(F.min("label").alias("label"))
    s = names.select(F.col("entity_id").alias("_s"), F.col("label").alias("_subject"))
    o = names.select(F.col("entity_id").alias("_o"), F.col("label").alias("_object"))
    out = claims.join(s, F.col("subject") == F.col("_s"), "inner" if strict else "left")
    out = out.join(o, (F.col("object") == F.col("_o")) & (F.col("object_type") == "entity"), "left")
    subject = F.col("_subject") if strict else F.coalesce("_subject", "subject")
    label = F.col("_object") if strict else F.coalesce("_object", "object")
    kept = [c for c in claims.columns if c not in ("subject", "object")]
    return out.select(*kept, F.col("subject").alias("subject_id"), F.col("object").alias("object_id"), subject.alias("subject"), object_label(F.col("object_type"), label, F.col("object")).alias("object"))


def provenance_chain(claims: DataFrame, entities: DataFrame, provenance: DataFrame, spans: DataFrame, locators: DataFrame | None = None) -> DataFrame:
    """claim -> provenance -> span [-> locator]: one row for each claim and span that proves it."""
    named = claims_resolved(claims, entities, strict=True)
    proof = provenance.select("claim_id", "source_hash", "byte_start", "byte_end")
    span = spans.select("source_hash", "byte_start", "byte_end", F.col("text").alias("evidence"), *(["span_id"] if locators is not None else []))
    out = named.join(proof, "claim_id").join(span, ["source_hash", "byte_start", "byte_end"])
    if locators is not None:
        # What locates a span goes to its place, where the chain is already; so the chain's texts are not dealt out again.
        at = locators.select("span_id", F.struct("span_id", "kind", "page_index", "paragraph_index").alias("_at"))
        places = spans.select("span_id", "source_hash", "byte_start", "byte_end").distinct().join(at, "span_id")
        places = places.groupBy("source_hash", "byte_start", "byte_end").agg(F.collect_list("_at").alias("_at"))
        out = out.join(places, ["source_hash", "byte_start", "byte_end"], "left")
        out = out.withColumn("_at", F.explode_outer(F.filter("_at", lambda x: x["span_id"] == F.col("span_id"))))
        out = out.select("*", "_at.kind", "_at.page_index", "_at.paragraph_index")
    extra = ["kind", "page_index", "paragraph_index"] if locators is not None else []
    return out.select("claim_id", "subject", "predicate", "object", "tier", "source_hash", "byte_start", "byte_end", "evidence", *extra)


def said_once(claims: DataFrame, entities: DataFrame, provenance: DataFrame, spans: DataFrame) -> DataFrame:
    """claim_id, source_hash, byte_start, byte_end of provenance, without the rows whose chain has the subject, predicate, object, bytes
    and evidence of another's; of one shard whose spans hold what lies at their bytes. Texts meet as digests, so none is shuffled to be made
    distinct. Beside them subject, predicate, _short (an object of at most ``SHORT`` characters) and _own: whether the object reads as the evidence."""
    digest = lambda c: F.unhex(F.sha2(c, 256))
    short = F.when(F.length("object") <= SHORT, F.col("object"))
    named = claims_resolved(claims, entities, strict=True).select("claim_id", "subject", "predicate", short.alias("_short"), digest("object").alias("_object"))
    said = spans.select("source_hash", "byte_start", "byte_end", digest("text").alias("_said"))
    proof = provenance.select("claim_id", "source_hash", "byte_start", "byte_end").join(named, "claim_id").join(said, ["source_hash", "byte_start", "byte_end"])
    one = F.min(F.struct("claim_id", "source_hash", "_short")).alias("_one")
    first = proof.groupBy("subject", "predicate", "_object", "_said", "byte_start", "byte_end").agg(one)
    return first.select("_one.*", "byte_start", "byte_end", "subject", "predicate", F.coalesce(F.col("_object") == F.col("_said"), F.lit(False)).alias("_own"))


def evidence_once(once: DataFrame, claims: DataFrame, entities: DataFrame, spans: DataFrame) -> DataFrame:
    """subject, predicate, object, byte_start, byte_end, evidence of the rows of ``said_once``, a table. Only claims whose object is neither
    short nor their evidence are asked for it again, if there are any."""
    columns = "subject", "predicate", "object", "byte_start", "byte_end", "evidence"
    near = F.col("_short").isNotNull() | F.col("_own")
    said = spans.select("source_hash", "byte_start", "byte_end", F.col("text").alias("evidence"))
    out = once.where(near).join(said, ["source_hash", "byte_start", "byte_end"]).withColumn("object", F.coalesce("_short", "evidence")).select(*columns)
    far = once.where(~near)
    return out if far.isEmpty() else out.unionByName(provenance_chain(claims, entities, far, spans).select(*columns))


def numbered_context(chain: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` links, numbered from 1 for citation."""
    from pyspark.sql.window import Window

    first = chain.orderBy("tier", "claim_id", "source_hash", "byte_start", "byte_end").limit(most)
    order = Window.orderBy("tier", "claim_id", "source_hash", "byte_start", "byte_end")
    return first.withColumn("cite", F.row_number().over(order))
