"""Schemas of the claim model. Core tables are fixed; extensions are versioned by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CORE = {
    "claims": "claim_id string, subject string, predicate string, object string, object_type string, tier int",
    "entities": "entity_id string, label string",
    "provenance": "provenance_id string, claim_id string, source_hash string, byte_start long, byte_end long",
    "spans": "span_id string, source_hash string, byte_start long, byte_end long, text string",
}
EXTENSIONS = {
    "locators": "evidence_addr string, span_id string, source_hash string, kind string, page_index smallint, paragraph_index int, block_id string, file_path string",
    "references": "src_claim_id string, relation_type string, dst_shard_id string, dst_object_type string, dst_object_id string, confidence float, note string",
    "lineage": "shard_id string, supersedes_shard_id string, action string, timestamp string, note string",
    "temporal": "claim_id string, valid_from string, valid_until string, temporal_context string",
    "coords": "entity_id string, major string, type string, subtype string, instance string",
}
#: Second names of union views.
ALIASES = {"references": "refs"}
KEYS = {
    "claims": ["claim_id"], "entities": ["entity_id"], "provenance": ["provenance_id"], "spans": ["span_id"],
    "locators": ["evidence_addr"], "references": ["src_claim_id", "dst_object_id"], "lineage": ["shard_id", "supersedes_shard_id"], "temporal": ["claim_id"], "coords": ["entity_id"],
}
CANDIDATE = "ordinal long, subject string, predicate string, object string, object_type string, evidence string, tier int, confidence double, extraction_method string, meta string"

#: Enumerations of the model.
OBJECT_TYPES = ("entity", "literal:integer", "literal:decimal", "literal:string", "literal:boolean")
RELATION_TYPES = ("supports", "contradicts", "derives_from", "supersedes", "cites")
LINEAGE_ACTIONS = ("supersede", "amend", "retract")
COLOURS = ("Green", "Yellow", "Red", "Black")


def extension_name(file_stem: str) -> tuple[str, int | None]:
    """``temporal@1`` -> (temporal, 1): versions are metadata, not part of a view's name."""
    m = re.fullmatch(r"(.+?)@(\d+)", file_stem)
    return (m[1], int(m[2])) if m else (file_stem, None)


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty, typed table with the columns that mounting adds."""
    return spark.createDataFrame([], f"{ {**CORE, **EXTENSIONS}[table] }, {'' if table == 'lineage' else 'shard_id string, '}mount_id string")
