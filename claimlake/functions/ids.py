"""Content-addressed identifiers as Catalyst expressions."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Joins the parts of an identifier; no part contains it.
UNIT = "\x1f"
#: The digits of base 32 as numbers are printed, and as RFC 4648 writes them in lower case.
_NUMERALS, _LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"


def b32(hex_digest: Column) -> Column:
    """First 15 bytes of a hex digest in lower-case base 32: six groups of 20 bits."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(6)]
    return F.translate(F.upper(F.concat(*groups)), _NUMERALS, _LETTERS)


def b32_id(prefix: str, *parts: Column) -> Column:
    body = F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), b32(F.sha2(body, 256)))


def b32_id_of(prefix: str, *parts: object) -> str:
    """The same on the driver."""
    digest = hashlib.sha256(UNIT.join("" if p is None else str(p) for p in parts).encode()).digest()[:15]
    return prefix + base64.b32encode(digest).decode().lower().rstrip("=")


def entity_id(namespace: Column, label: Column) -> Column:
    return b32_id("e_", namespace, label)


def claim_id(subject: Column, predicate: Column, obj: Column, object_type: Column) -> Column:
    return b32_id("c_", subject, predicate, obj, object_type)


def source_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def evidence_addr(source: Column, start: Column, end: Column) -> Column:
    return b32_id("ea_", source, start, end)


def span_id(source: Column, start: Column, end: Column, text: Column) -> Column:
    return b32_id("s_", source, start, end, text)


def provenance_id(source: Column, start: Column, end: Column) -> Column:
    return b32_id("p_", source, start, end)


def interaction_id(ts: Column, query: Column) -> Column:
    return F.concat(F.lit("int_"), F.substring(F.sha2(F.concat(ts, F.lit(":"), query), 256), 1, 16))


def register(spark: SparkSession) -> None:
    """SQL functions with an expression body, so that the optimizer sees through them."""
    group = "lpad(conv(substr(h, {0}, 5), 16, 32), 4, '0')"
    body = f"translate(upper(concat({', '.join(group.format(5 * i + 1) for i in range(6))})), '{_NUMERALS}', '{_LETTERS}')"
    spark.sql(f"create or replace temporary function b32_hex(h string) returns string return {body}")
    spark.sql("create or replace temporary function b32_id(prefix string, body string) returns string return concat(prefix, b32_hex(sha2(body, 256)))")
    spark.sql("create or replace temporary function entity_id(namespace string, label string) returns string return b32_id('e_', concat(namespace, char(31), label))")
    spark.sql("create or replace temporary function claim_id(s string, p string, o string, t string) returns string return b32_id('c_', concat_ws(char(31), s, p, o, t))")
    spark.sql("create or replace temporary function evidence_addr(source string, a bigint, z bigint) returns string return b32_id('ea_', concat_ws(char(31), source, cast(a as string), cast(z as string)))")
