"""The star-schema test tables seen as claims, evidence, references and so on, for registered queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.scalar import ISO
from claimlake.operators.extract import lines


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _short(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def seconds(c: str) -> Column:
    """Seconds since 1970 with their fraction, of a timestamp with or without a zone."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def decision_claims(spark: SparkSession, sf: str) -> DataFrame:
    verbs = {"click": "chose", "view": "proposed", "purchase": "approved", "error": "rejected"}
    predicate = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in verbs.items()], F.lit("viewed_only"))
    return read(spark, sf, "events").select(
        "event_id",
        _short("c_", _text("user_id"), F.col("event_type"), _text("event_id")).alias("claim_id"),
        F.concat(F.lit("user_"), _text("user_id")).alias("subject"),
        predicate.alias("predicate"),
        F.get_json_object("props", "$.k").alias("object"),
        F.lit("literal:integer").alias("object_type"),
        (F.col("event_id") % 4).cast("int").alias("tier"),
        F.when(F.col("event_id") % 2 == 0, "shard_a").otherwise("shard_b").alias("shard_id"),
    )


def temporal(spark: SparkSession, sf: str) -> DataFrame:
    iso = lambda c: F.date_format(c, ISO)
    until = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 2, iso(F.col("ts") + F.expr("interval 30 days")))
    kind = F.when(F.col("event_id") % 5 == 0, "unknown").otherwise(F.col("event_type"))  # no claim has this id
    return read(spark, sf, "events").select(
        _short("c_", _text("user_id"), kind, _text("event_id")).alias("claim_id"), iso(F.col("ts")).alias("valid_from"), until.alias("valid_until"), F.concat_ws(": ", "event_type", F.get_json_object("props", "$.k")).alias("temporal_context")
    )


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim refers to the claim of the next event, which is of the other shard."""
    e = read(spark, sf, "events").select("event_id", _short("c_", _text("user_id"), F.col("event_type"), _text("event_id")).alias("claim_id"))
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("claim_id").alias("dst_object_id"))
    kinds = F.array(*map(F.lit, ("supports", "contradicts", "derives_from", "supersedes", "cites")))
    other = F.when(F.col("event_id") % 10 == 8, "shard_missing").when(F.col("event_id") % 2 == 0, "shard_b").otherwise("shard_a")
    return e.join(b, "event_id").select(
        F.col("claim_id").alias("src_claim_id"),
        F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("relation_type"),
        other.alias("dst_shard_id"),
        F.lit("claim").alias("dst_object_type"),
        "dst_object_id",
        ((F.col("event_id") % 10).cast("double") / 10).alias("confidence"),
    )


def lineage(spark: SparkSession, sf: str) -> DataFrame:
    shard = lambda c: F.concat(F.lit("shard_n"), c.cast("string"))
    action = F.element_at(F.array(F.lit("supersede"), F.lit("amend"), F.lit("retract")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    before = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("origin"), F.col("n_nationkey").cast("string"))).otherwise(shard(F.col("n_nationkey") - 1))
    return read(spark, sf, "nation").select(shard(F.col("n_nationkey")).alias("shard_id"), before.alias("supersedes_shard_id"), action.alias("action"), F.format_string("2024-01-%02dT00:00:00Z", F.col("n_nationkey") + 1).alias("timestamp"), F.lit(None).cast("string").alias("note"))


def titled_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Decision claims and, for every user, a title."""
    d = decision_claims(spark, sf).drop("event_id")
    title = d.groupBy("subject").agg(F.min("shard_id").alias("shard_id")).select(
        F.concat(F.lit("c_title_"), "subject").alias("claim_id"), "subject", F.lit("has_title").alias("predicate"), F.concat(F.lit("Notes of "), "subject").alias("object"), F.lit("literal:string").alias("object_type"), F.lit(0).alias("tier"), "shard_id"
    )
    return d.unionByName(title)


class Evidence:
    """Lines of documents as spans; each line is a claim about its document's language."""

    def __init__(self, spark: SparkSession, sf: str):
        docs = read(spark, sf, "documents")
        self.lines = lines(docs.withColumn("source_hash", F.sha2("text", 256)), "lang", "source", "source_hash").where("line <> ''")
        lang, source = _short("e_", F.concat(F.lit("lang|"), "lang")), _short("e_", F.concat(F.lit("source|"), "source"))
        self.entities = docs.select(lang.alias("entity_id"), F.concat(F.lit("lang:"), "lang").alias("label")).union(docs.select(source, F.concat(F.lit("source:"), "source"))).distinct()
        claim = _short("c_", _text("doc_id"), _text("pos"))
        even = F.col("pos") % 2 == 0
        self.claims = self.lines.select(
            claim.alias("claim_id"), lang.alias("subject"), F.lit("has_line").alias("predicate"), F.when(even, source).otherwise(F.col("line")).alias("object"), F.when(even, "entity").otherwise("literal:string").alias("object_type"), (F.col("pos") % 4).cast("int").alias("tier")
        )
        self.provenance = self.lines.select(claim.alias("claim_id"), "source_hash", "byte_start", "byte_end")
        span = _short("s_", F.col("source_hash"), _text("byte_start"), _text("byte_end"))
        self.spans = self.lines.select(span.alias("span_id"), "source_hash", "byte_start", "byte_end", F.col("line").alias("text")).distinct()
        located = self.lines.groupBy("source_hash", "byte_start", "byte_end").agg(F.min("pos").alias("paragraph_index"))
        moved = F.when(F.col("paragraph_index") % 3 == 0, F.reverse("source_hash")).otherwise(F.col("source_hash"))  # no span has this id
        self.locators = located.select(_short("s_", moved, _text("byte_start"), _text("byte_end")).alias("span_id"), F.lit("text").alias("kind"), F.lit(0).cast("smallint").alias("page_index"), "paragraph_index")


#: The same projections for the oracle.
ORACLE = {
    "dclaims": """select event_id, concat('c_', substr(sha256(concat_ws('|', user_id::varchar, event_type, event_id::varchar)), 1, 24)) as claim_id,
  concat('user_', user_id::varchar) as subject,
  case event_type when 'click' then 'chose' when 'view' then 'proposed' when 'purchase' then 'approved' when 'error' then 'rejected' else 'viewed_only' end as predicate,
  json_extract_string(props, '$.k') as object, 'literal:integer' as object_type, (event_id % 4)::int as tier,
  case when event_id % 2 = 0 then 'shard_a' else 'shard_b' end as shard_id from events""",
    "temporal": """select concat('c_', substr(sha256(concat_ws('|', user_id::varchar, case when event_id % 5 = 0 then 'unknown' else event_type end, event_id::varchar)), 1, 24)) as claim_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as valid_from,
  case event_id % 3 when 0 then '' when 1 then null else strftime(ts + interval '30' day, '%Y-%m-%dT%H:%M:%SZ') end as valid_until,
  concat(event_type, ': ', json_extract_string(props, '$.k')) as temporal_context from events""",
    "refs": """select a.claim_id as src_claim_id,
  case a.event_id % 5 when 0 then 'supports' when 1 then 'contradicts' when 2 then 'derives_from' when 3 then 'supersedes' else 'cites' end as relation_type,
  case when a.event_id % 10 = 8 then 'shard_missing' when a.event_id % 2 = 0 then 'shard_b' else 'shard_a' end as dst_shard_id, 'claim' as dst_object_type, b.claim_id as dst_object_id,
  (a.event_id % 10)::double / 10 as confidence
  from dclaims a join dclaims b on b.event_id = a.event_id + 1""",
    "lineage": """select concat('shard_n', n_nationkey::varchar) as shard_id, case when n_nationkey % 5 = 0 then concat('origin', n_nationkey::varchar) else concat('shard_n', (n_nationkey - 1)::varchar) end as supersedes_shard_id,
  case n_nationkey % 3 when 0 then 'supersede' when 1 then 'amend' else 'retract' end as action,
  concat('2024-01-', lpad((n_nationkey + 1)::varchar, 2, '0'), 'T00:00:00Z') as timestamp, null::varchar as note from nation""",
    "tclaims": """select claim_id, subject, predicate, object, object_type, tier, shard_id from dclaims union all
  select concat('c_title_', subject), subject, 'has_title', concat('Notes of ', subject), 'literal:string', 0, min(shard_id) from dclaims group by subject""",
    "dl": """select doc_id, lang, source, source_hash, pos, line, bend - strlen(line) as byte_start, bend as byte_end from (
  select *, (sum(strlen(line) + 1) over (partition by doc_id order by pos) - 1)::bigint as bend from (
    select sha256(text) as source_hash, doc_id, lang, source, unnest(range(len(ls)))::int as pos, unnest(ls) as line
    from (select *, string_split(text, chr(10)) as ls from documents))) where line <> ''""",
    "entities": """select distinct concat('e_', substr(sha256(concat('lang|', lang)), 1, 24)) as entity_id, concat('lang:', lang) as label from documents
  union select distinct concat('e_', substr(sha256(concat('source|', source)), 1, 24)), concat('source:', source) from documents""",
    "claims": """select concat('c_', substr(sha256(concat_ws('|', doc_id::varchar, pos::varchar)), 1, 24)) as claim_id,
  concat('e_', substr(sha256(concat('lang|', lang)), 1, 24)) as subject, 'has_line' as predicate,
  case when pos % 2 = 0 then concat('e_', substr(sha256(concat('source|', source)), 1, 24)) else line end as object,
  case when pos % 2 = 0 then 'entity' else 'literal:string' end as object_type, (pos % 4)::int as tier from dl""",
    "provenance": "select concat('c_', substr(sha256(concat_ws('|', doc_id::varchar, pos::varchar)), 1, 24)) as claim_id, source_hash, byte_start, byte_end from dl",
    "spans": "select distinct concat('s_', substr(sha256(concat_ws('|', source_hash, byte_start::varchar, byte_end::varchar)), 1, 24)) as span_id, source_hash, byte_start, byte_end, line as text from dl",
    "locators": """select concat('s_', substr(sha256(concat_ws('|', case when paragraph_index % 3 = 0 then reverse(source_hash) else source_hash end, byte_start::varchar, byte_end::varchar)), 1, 24)) as span_id, 'text' as kind, 0::smallint as page_index, paragraph_index
  from (select source_hash, byte_start, byte_end, min(pos) as paragraph_index from dl group by source_hash, byte_start, byte_end)""",
}
NEEDS = {"refs": ["dclaims"], "tclaims": ["dclaims"], "claims": ["dl"], "provenance": ["dl"], "spans": ["dl"], "locators": ["dl"]}


def with_ctes(names: str, sql: str, recursive: bool = False) -> str:
    """``sql`` under the projections it names."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(f"{n} as ({ORACLE[n]})" for n in wanted) + "\n" + sql
