"""The registered queries of the claim engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.functions import ids, scalar
from claimlake.operators import adaptive, bind, chunk, constraints, decisions, derive, extract, firewall, graph, nlq, resolve, validate, vector
from claimlake.plans import projections as p
from claimlake.plans.projections import read, seconds
from claimlake.plans.registered import ORACLES, QUERIES, register, rows  # noqa: F401
from claimlake.runtime import scratch
from claimlake.sources import chat, documents, shards
from claimlake.streaming import logs

# --- provenance and unions -------------------------------------------------------------------------------------------
CHAIN = """select c.claim_id, s.label as subject, c.predicate, case when c.object_type = 'entity' then o.label else c.object end as object, c.tier,
  p.source_hash, p.byte_start, p.byte_end, sp.text as evidence{0}
from claims c join entities s on c.subject = s.entity_id left join entities o on c.object = o.entity_id and c.object_type = 'entity'
join provenance p on c.claim_id = p.claim_id
join spans sp on p.source_hash = sp.source_hash and p.byte_start = sp.byte_start and p.byte_end = sp.byte_end{1}"""


@register(CHAIN.format("", ""), "claims entities provenance spans")
def provenance_chain(spark, sf):
    e = p.Evidence(spark, sf)
    return resolve.provenance_chain(e.claims, e.entities, e.provenance, e.spans)


@register(CHAIN.format(", l.kind, l.page_index, l.paragraph_index", " left join locators l on l.span_id = sp.span_id"), "claims entities provenance spans locators")
def provenance_chain_locators(spark, sf):
    e = p.Evidence(spark, sf)
    return resolve.provenance_chain(e.claims, e.entities, e.provenance, e.spans, e.locators)


@register("select c.claim_id, coalesce(s.label, c.subject) as subject, c.predicate, case when c.object_type = 'entity' then coalesce(o.label, c.object) else c.object end as object, c.tier from claims c left join entities s on c.subject = s.entity_id left join entities o on c.object = o.entity_id and c.object_type = 'entity'", "claims entities")
def claims_resolved(spark, sf):
    e = p.Evidence(spark, sf)
    return resolve.claims_resolved(e.claims, e.entities).select("claim_id", "subject", "predicate", "object", "tier")


@register("select shard_id, count(*) as n, count(distinct subject) as n_subjects from dclaims group by shard_id", "dclaims")
def union_views(spark, sf):
    d = p.decision_claims(spark, sf)
    a, b = (d.where(F.col("shard_id") == s).drop("shard_id").withColumn("shard_id", F.lit(s)) for s in ("shard_a", "shard_b"))
    return a.unionByName(b).groupBy("shard_id").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"))


@register("select claim_id, subject, predicate, object from dclaims where shard_id = 'shard_b' and tier <= 1", "dclaims")
def filtered_union(spark, sf):
    d = p.decision_claims(spark, sf)
    a, b = (d.where(F.col("shard_id") == s).drop("shard_id").withColumn("shard_id", F.lit(s)) for s in ("shard_a", "shard_b"))
    return a.unionByName(b).where("shard_id = 'shard_b' and tier <= 1").select("claim_id", "subject", "predicate", "object")


# --- questions ---------------------------------------------------------------------------------------------------------
VERBS = "(" + ", ".join(f"'{v}'" for v in nlq.DECISIONS) + ")"
DATED = f"from tclaims c left join temporal t on c.claim_id = t.claim_id where c.predicate in {VERBS}"
TIMELINE = "select c.subject, c.predicate, c.object, t.valid_from as decided_at, c.shard_id " + DATED
BY_TIME = " order by t.valid_from asc nulls last, c.subject, c.predicate, c.object, c.claim_id limit 50"


def _ask(question: str) -> Query:
    return lambda spark, sf: nlq.ask(question, p.titled_claims(spark, sf), p.temporal(spark, sf), p.lineage(spark, sf))


def _question(name: str, question: str, sql: str, ctes: str = "tclaims temporal") -> None:
    fn = _ask(question)
    fn.__name__ = name
    register(sql, ctes)(fn)


_question(
    "nl_contradictions",
    "Which decisions contradict each other?",
    f"""select a.subject, a.predicate, a.object as decision_a, b.object as decision_b, a.shard_id as shard_a, b.shard_id as shard_b
from tclaims a join tclaims b on a.subject = b.subject and a.predicate = b.predicate and a.object <> b.object and a.claim_id < b.claim_id
where a.predicate in {VERBS} order by a.subject, a.predicate, a.claim_id, b.claim_id limit 50""",
)
_question("nl_timeline", "Show the timeline", TIMELINE + BY_TIME)
_question("nl_timeline_topic", "timeline of user_12?", TIMELINE + " and (contains(lower(c.object), 'user_12') or contains(lower(c.subject), 'user_12'))" + BY_TIME)
_question(
    "nl_staleness",
    "What is stale?",
    "select c.subject, c.predicate, c.object, t.valid_from as decided_at, t.valid_until, c.shard_id " + DATED + " and (t.valid_until is null or t.valid_until = '') order by t.valid_from asc nulls first, c.subject, c.predicate, c.object, c.claim_id limit 50",
)
_question("nl_lineage", "What was superseded?", "select shard_id as current_shard, supersedes_shard_id as replaced_shard, action, timestamp, note from lineage order by timestamp desc nulls last, shard_id, supersedes_shard_id limit 50", "lineage")
_question("nl_changed_since", "what changed since 2024-01-10", TIMELINE + " and t.valid_from >= '2024-01-10'" + BY_TIME)
_question(
    "nl_decisions_about",
    "what did we decide about user_1?",
    "select distinct c.subject, c.predicate, c.object, t.valid_from as decided_at, c.shard_id " + DATED + " and (contains(lower(c.object), 'user_1') or contains(lower(c.subject), 'user_1'))",
)
_question("nl_all_decisions", "list all decisions", TIMELINE + BY_TIME)
_question("nl_list_titles", "show all conversations", "select distinct subject, object as title from tclaims where predicate = 'has_title'", "tclaims")
_question(
    "nl_topic",
    "anything about user_3?",
    "select distinct c.subject as conversation, t.object as title from tclaims c join tclaims t on c.subject = t.subject and t.predicate = 'has_title' where c.predicate = 'has_title' or contains(lower(c.object), 'user_3') or contains(lower(c.subject), 'user_3')",
    "tclaims",
)
_question(
    "nl_show_find",
    "find user_7",
    "select distinct subject, predicate, object, shard_id from tclaims where contains(lower(object), 'user_7') or contains(lower(subject), 'user_7') order by 1, 2, 3, 4 limit 50",
    "tclaims",
)
_question(
    "nl_keyword",
    "user_11 notes",
    "select distinct subject, predicate, object, shard_id from tclaims where contains(lower(object), 'user_11') or contains(lower(subject), 'user_11') or contains(lower(object), 'notes') or contains(lower(subject), 'notes') order by 1, 2, 3, 4 limit 50",
    "tclaims",
)
_question("nl_nothing", "and so?", "select distinct subject, object as title from tclaims where predicate = 'has_title' order by subject, title limit 50", "tclaims")


# --- references, lineage, differences ------------------------------------------------------------------------------------
@register("select * from refs", "refs")
def xref_list(spark, sf):
    return graph.list_references(p.references(spark, sf))


@register(
    """select a.claim_id as src_claim_id, a.predicate as action, a.object as target, a.tier, r.relation_type, r.confidence, b.claim_id as dst_object_id, b.predicate as doctrine_predicate, b.object as doctrine_object
from dclaims a join refs r on r.src_claim_id = a.claim_id join dclaims b on b.claim_id = r.dst_object_id where a.tier <= 1""",
    "dclaims refs",
)
def xref_join(spark, sf):
    d = p.decision_claims(spark, sf)
    return graph.cross_shard(d, p.references(spark, sf), d)


@register(
    """select a.claim_id, a.predicate as action, a.tier, r.relation_type as relation, r.confidence, s.span_id, left(s.text, 120) as doctrine_evidence
from dclaims a join refs r on r.src_claim_id = a.claim_id join spans s on s.source_hash = (select min(source_hash) from spans)
where a.tier <= 1 and r.dst_shard_id = 'shard_b' order by a.tier, r.confidence desc, a.claim_id, r.relation_type, s.span_id limit 10""",
    "dclaims refs spans",
)
def xref_spans(spark, sf):
    return graph.cross_shard_spans(p.decision_claims(spark, sf), p.references(spark, sf), p.Evidence(spark, sf).spans, "shard_b").select("claim_id", "action", "tier", "relation", "confidence", "span_id", "doctrine_evidence")


@register("select dst_shard_id, count(*) as n_refs, case when dst_shard_id in (select shard_id from dclaims) then 'MOUNTED' else 'BROKEN' end as status from refs group by dst_shard_id", "dclaims refs")
def xref_integrity(spark, sf):
    return graph.reference_integrity(p.references(spark, sf), p.decision_claims(spark, sf).select("shard_id"))


@register("select r.src_claim_id, r.dst_object_id, r.dst_shard_id from refs r where not exists (select 1 from dclaims d where d.claim_id = r.dst_object_id and d.tier > 1)", "dclaims refs")
def xref_broken(spark, sf):
    return graph.broken_references(p.references(spark, sf), p.decision_claims(spark, sf).where("tier > 1")).select("src_claim_id", "dst_object_id", "dst_shard_id")


@register(
    """, ch(root, cur, depth) as (select shard_id, supersedes_shard_id, 1 from lineage union all select ch.root, l.supersedes_shard_id, ch.depth + 1 from ch join lineage l on l.shard_id = ch.cur)
select root, cur, depth from ch""",
    "lineage",
    recursive=True,
)
def lineage_chain(spark, sf):
    return graph.lineage_closure(p.lineage(spark, sf))


BASE = "select claim_id, subject, predicate, object, tier from dclaims where event_id % 10 <> 0"
DELTA = "select claim_id, subject, predicate, case when event_id % 7 = 0 then concat(object, 'x') else object end as object, tier from dclaims where event_id % 10 <> 1"


def _versions(spark, sf):
    d = p.decision_claims(spark, sf)
    cols = ["claim_id", "subject", "predicate", "object", "tier"]
    delta = d.where("event_id % 10 <> 1").withColumn("object", F.when(F.col("event_id") % 7 == 0, F.concat("object", F.lit("x"))).otherwise(F.col("object")))
    return d.where("event_id % 10 <> 0").select(*cols), delta.select(*cols)


@register(f"select claim_id from ({DELTA}) except select claim_id from ({BASE})", "dclaims")
def diff_added(spark, sf):
    return graph.added(*_versions(spark, sf), ["claim_id"])


@register(f"select claim_id from ({BASE}) except select claim_id from ({DELTA})", "dclaims")
def diff_removed(spark, sf):
    return graph.removed(*_versions(spark, sf), ["claim_id"])


@register(f"select b.claim_id from ({BASE}) b join ({DELTA}) d on b.claim_id = d.claim_id where b <> d", "dclaims")
def diff_modified(spark, sf):
    return graph.modified(*_versions(spark, sf), ["claim_id"])


@register(f"select coalesce(b.claim_id, d.claim_id) as claim_id, case when b.claim_id is null then 'added' when d.claim_id is null then 'removed' else 'modified' end as change from ({BASE}) b full join ({DELTA}) d on b.claim_id = d.claim_id where b.claim_id is null or d.claim_id is null or b <> d", "dclaims")
def diff_all(spark, sf):
    return graph.diff(*_versions(spark, sf), ["claim_id"])


# --- extraction -----------------------------------------------------------------------------------------------------------
@register("select c_name as subject, predicate, object, 'literal:string' as object_type, concat(predicate, ': ', object) as evidence, 0 as tier from (select c_name, c_nationkey::varchar as c_nationkey, c_mktsegment from customer) unpivot (object for predicate in (c_nationkey, c_mktsegment)) where trim(object) <> ''")
def tier0_lift(spark, sf):
    return extract.structured_lift(read(spark, sf, "customer").select("c_name", "c_nationkey", "c_mktsegment"))


@register("select doc_id, pos, line, byte_start, byte_end from dl", "dl")
def line_spans(spark, sf):
    return extract.lines(read(spark, sf, "documents")).where("line <> ''")


@register(
    """select path, (coalesce(sum(h + n + 1) over (order by path rows between unbounded preceding and 1 preceding), 0) + h)::bigint as byte_start, (coalesce(sum(h + n + 1) over (order by path rows between unbounded preceding and 1 preceding), 0) + h + n)::bigint as byte_end
from (select concat('d', lpad(doc_id::varchar, 9, '0')) as path, strlen(concat('=== d', lpad(doc_id::varchar, 9, '0'), ' ===', chr(10))) as h, strlen(text) as n from documents)"""
)
def source_offsets(spark, sf):
    docs = read(spark, sf, "documents")
    return extract.source_offsets(docs.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text"))


@register("select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", scalar.strip_tags(F.col("html")).alias("text"))


@register()
def html_blocks(spark, sf):
    return documents.html_pages(read(spark, sf, "pages"))


ROLE = "case when lower(role) in ('human', 'user') then 'HUMAN' when lower(role) in ('assistant', 'claude') then 'ASSISTANT' else upper(role) end"


@register(f"select conv_id, turn as turn_index, {ROLE} as role, concat({ROLE}, ':', chr(10), text) as block from conversations where trim(coalesce(text, '')) <> ''")
def conversation_blocks(spark, sf):
    return chat.blocks(read(spark, sf, "conversations"))


@register("select conv_id, count(*) filter (where lower(role) <> 'meta') as message_count from conversations group by conv_id")
def conversation_meta(spark, sf):
    return chat.metadata(read(spark, sf, "conversations"))


@register()
def legal_chunks(spark, sf):
    return chunk.legal_chunks(read(spark, sf, "documents"))


@register()
def sentence_spans(spark, sf):
    return chunk.sentences(read(spark, sf, "documents"))


@register(
    """, n as (select doc_id, max(pos) + 1 as n from dl group by doc_id), starts as (select doc_id, unnest(range(0, n::bigint, 15))::int as batch_start from n)
select d.doc_id, s.batch_start, d.pos as index from starts s join dl d on d.doc_id = s.doc_id and d.pos >= s.batch_start and d.pos < s.batch_start + 20""",
    "dl",
)
def batch_windows(spark, sf):
    lines = extract.lines(read(spark, sf, "documents")).where("line <> ''").select("doc_id", F.col("pos").alias("index"))
    return chunk.batches(lines, lines.groupBy("doc_id").agg((F.max("index") + 1).alias("n")))


@register("select l.doc_id, l.pos, ((strlen(d.text) - strlen(replace(d.text, l.line, ''))) / strlen(l.line))::int as n_found from dl l join documents d on d.doc_id = l.doc_id", "dl")
def unique_evidence(spark, sf):
    docs = read(spark, sf, "documents")
    found = bind.unique_evidence(extract.lines(docs).where("line <> ''").withColumnRenamed("line", "evidence"), docs)
    return found.select("doc_id", "pos", "n_found")


@register(
    """, q as (select l.doc_id, l.pos, l.line, l.source_hash, case l.pos % 4 when 2 then l.byte_start + 1 else l.byte_start end as a, case l.pos % 4 when 3 then l.byte_end - 1 else l.byte_end end as b from dl l)
select q.doc_id, q.pos, exists (select 1 from dl o where o.doc_id = q.doc_id and o.byte_start = q.a and o.byte_end = q.b and o.line = q.line) as ok from q""",
    "dl",
)
def byte_exact_check(spark, sf):
    docs = read(spark, sf, "documents")
    shifted = {"byte_start": F.col("byte_start") + F.when(F.col("pos") % 4 == 2, 1).otherwise(0), "byte_end": F.col("byte_end") - F.when(F.col("pos") % 4 == 3, 1).otherwise(0)}
    found = validate.byte_exact_evidence(extract.lines(docs).where("line <> ''").withColumnRenamed("line", "evidence").withColumns(shifted), docs)
    return found.select("doc_id", "pos", "ok")


@register("select source_hash, byte_start, byte_end, 'beyond_source' as reason from (select sha256(text) as source_hash, 0::bigint as byte_start, (strlen(text) + 1)::bigint as byte_end from documents where doc_id % 10 = 0) union all select source_hash, byte_start, byte_end, 'invalid_range' from (select sha256(text) as source_hash, 5::bigint as byte_start, 2::bigint as byte_end from documents where doc_id % 10 = 1)")
def span_bounds_violations(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"), F.octet_length("text").cast("long").alias("size"))
    end = F.when(F.col("doc_id") % 10 == 0, F.col("size") + 1).when(F.col("doc_id") % 10 == 1, F.lit(2)).otherwise(F.col("size"))
    spans = docs.select("source_hash", F.when(F.col("doc_id") % 10 == 1, 5).otherwise(0).cast("long").alias("byte_start"), end.cast("long").alias("byte_end"))
    return validate.span_bounds(spans, docs)


# --- derivations --------------------------------------------------------------------------------------------------------------
@register(
    """select concat('p', p_partkey::varchar) as entity_id, 'x' as dummy, major, type, subtype, concat(lpad(major::varchar, 2, '0'), '-', lpad(type::varchar, 2, '0'), '-', lpad(subtype::varchar, 2, '0'), '-', case when n < 1000 then lpad(n::varchar, 4, '0') else n::varchar end) as instance from (
select *, row_number() over (partition by major, type, subtype order by concat('p', p_partkey::varchar)) as n from (
select p_partkey, case when p_size % 4 = 0 then 6 when p_size % 4 = 1 then 7 when p_size % 4 = 2 then 1 else 8 end as major, case when p_size % 4 = 1 then 3 when p_size % 4 = 3 then 4 when p_size % 4 = 2 then 2 else 1 end as type, 1 as subtype from part))"""
)
def coords_derive(spark, sf):
    word = F.element_at(F.array(*map(F.lit, ("fiscal year", "total dose", "patient group", "zzz"))), (F.col("p_size") % 4 + 1).cast("int"))
    at = derive.coords(read(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), word.alias("label")))
    return at.select("entity_id", F.lit("x").alias("dummy"), "major", "type", "subtype", "instance")


@register("select tier, count(*) as n, round(avg(c), 4) as mean, round(min(c), 4) as least, round(max(c), 4) as most from (select tier, (event_id % 10)::double / 10 as c from dclaims) group by rollup (tier)", "dclaims")
def confidence_summary(spark, sf):
    return derive.confidence_summary(p.decision_claims(spark, sf).withColumn("confidence", (F.col("event_id") % 10).cast("double") / 10))


@register("select predicate, count(*) as n from dclaims group by predicate order by n desc, predicate limit 20", "dclaims")
def top_predicates(spark, sf):
    return derive.top_predicates(p.decision_claims(spark, sf))


@register(r"""select claim_id, predicate, object_type, try_cast(object as bigint) as object_int from dclaims""", "dclaims")
def claims_typed(spark, sf):
    return scalar.typed(p.decision_claims(spark, sf)).select("claim_id", "predicate", "object_type", "object_int")


# --- firewall, decisions, bundles ------------------------------------------------------------------------------------------------
@register(
    """with b as (select n_nationkey as id, n_regionkey % 3 as domain, n_nationkey % 4 as scenario, [n_regionkey, n_nationkey % 2 + 10] as tags from nation),
scored as (select b.id as bundle_id, t.id as target_id, ((b.domain = t.domain)::int::double + (b.scenario = t.scenario)::int::double + len(list_intersect(b.tags, t.tags))::double / len(list_distinct(list_concat(b.tags, t.tags)))) / 3 as score from b, b t)
select bundle_id, target_id, score from scored where score >= 0.6 and bundle_id <> target_id"""
)
def context_similarity(spark, sf):
    n = read(spark, sf, "nation")
    b = n.select(F.col("n_nationkey").alias("bundle_id"), F.col("n_nationkey").alias("source"), (F.col("n_regionkey") % 3).alias("domain"), (F.col("n_nationkey") % 4).alias("scenario"), F.array("n_regionkey", F.col("n_nationkey") % 2 + 10).alias("tags"))
    return adaptive.context_fit(b, b.withColumnRenamed("bundle_id", "target_id"))


@register(
    """with s as (select user_id, count(*) as n, avg(v) as mean, var_pop(v) as variance from (select user_id, (event_id % 20)::double / 100 as v from events) group by user_id),
b as (select distinct user_id as bundle_id, (user_id % 10)::double / 10 as context_score from events)
select b.bundle_id, b.context_score, coalesce(s.n, 0)::bigint as n, case when b.context_score < 0.6 then 'reject' when coalesce(s.mean, 0.1) < 0.1 then 'reject' when coalesce(s.n, 0) < 10 then 'test_more' else 'adopt' end as recommendation,
 case when s.n > 0 then round(1 / (1 + s.variance), 9) else 0.5 end as stability from b left join s on s.user_id = b.bundle_id"""
)
def bundle_evaluation(spark, sf):
    """Doubles are added in the order of the table's rows, as the SQL's average takes them: means of just the threshold go by it."""
    e = read(spark, sf, "events")
    b = e.select(F.col("user_id").alias("bundle_id")).distinct().withColumns({"context_score": (F.col("bundle_id") % 10).cast("double") / 10, "baseline": F.lit(1.0), "improved": F.lit(1.1)})
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    shadows = e.select(F.col("user_id").alias("bundle_id"), ((F.col("event_id") % 20).cast("double") / 100).alias("improvement"), *place)
    return adaptive.evaluate(b, shadows, ("file", "row")).select("bundle_id", "context_score", "n", "recommendation", F.round("stability", 9).alias("stability"))


@register(
    """with recursive r as (select user_id as rule_id, epoch(ts) as ts, (event_id % 7)::double as value from events), o as (select *, row_number() over (partition by rule_id order by ts, value) as i from r),
w(rule_id, i, until, num) as (select rule_id, i, ts + 86400, 0 from o where i = 1 union all
  select o.rule_id, o.i, case when o.ts > w.until then o.ts + 86400 else w.until end, case when o.ts > w.until then w.num + 1 else w.num end from w join o on o.rule_id = w.rule_id and o.i = w.i + 1)
select o.rule_id, w.num::bigint as "window", count(*) as n, sum(o.value) as total from w join o on o.rule_id = w.rule_id and o.i = w.i group by o.rule_id, w.num"""
)
def rule_windows(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("rule_id"), seconds("ts").alias("ts"), (F.col("event_id") % 7).cast("double").alias("value"))
    return adaptive.windows_from_first(e, 86400).groupBy("rule_id", "window").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@register("select event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as least, max(value) as most from events group by event_type")
def shadow_summary(spark, sf):
    return adaptive.shadow_summary(read(spark, sf, "events").withColumnRenamed("event_type", "metric")).select(F.col("metric").alias("event_type"), "n", F.round("mean", 6).alias("mean"), "least", "most")


@register("select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), 5) as score from embeddings order by score desc, vec_id limit 10")
def vector_topk(spark, sf):
    return vector.top_k_for_id(read(spark, sf, "embeddings"), 0)


# --- streams, worked off once ---------------------------------------------------------------------------------------------------
def _event_stream(spark, sf):
    schema = read(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", "4").parquet(sf).withColumn("at", F.col("ts").cast("timestamp"))


@register("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n from events group by 1, 2 having time_bucket(interval '1 day', ts) + interval '1 day' <= (select max(ts) from events) - interval '1 hour'")
def stream_windowed_counts(spark, sf):
    counts = logs.windowed_counts(_event_stream(spark, sf), "at", "event_type", "value", "1 day", "1 hour")
    return logs.run_once(counts).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("select count(*) as n, count(distinct event_id) as n_ids from events")
def stream_deduplicated(spark, sf):
    twice = _event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return logs.run_once(logs.deduplicated(twice, "at", ["event_id"], "3650 days").select("event_id")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


@register("select user_id::varchar as stream_id, previous, event_id as seq from (select user_id, event_id, lag(event_id) over (partition by user_id order by event_id) as previous from events) where previous is not null and event_id <> previous + 1")
def stream_sequence_gaps(spark, sf):
    stream = _event_stream(spark, sf).select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("seq"))
    return logs.run_once(logs.sequence_gaps(stream))


@register(
    """with recursive r as (select user_id::varchar as rule_id, epoch(ts) as ts, (event_id % 7)::double as value from events), o as (select *, row_number() over (partition by rule_id order by ts, value) as i from r),
w(rule_id, i, until, num) as (select rule_id, i, ts + 86400, 0 from o where i = 1 union all
  select o.rule_id, o.i, case when o.ts > w.until then o.ts + 86400 else w.until end, case when o.ts > w.until then w.num + 1 else w.num end from w join o on o.rule_id = w.rule_id and o.i = w.i + 1)
select o.rule_id, w.num::bigint as "window", count(*) as n, sum(o.value) as total from w join o on o.rule_id = w.rule_id and o.i = w.i group by o.rule_id, w.num having min(o.ts) + 86400 < (select max(ts) from o)"""
)
def stream_rule_windows(spark, sf):
    """The events arrive in two parts; the second starts anew from the first one's checkpoint."""
    ts = seconds("ts")
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("rule_id"), ts.alias("ts"), (F.col("event_id") % 7).cast("double").alias("value"))
    half = e.agg(((F.min("ts") + F.max("ts")) / 2).alias("half"))
    e = e.crossJoin(F.broadcast(half))  # one row
    source, folder = scratch(spark), scratch(spark)
    for part in (F.col("ts") <= F.col("half"), F.col("ts") > F.col("half")):
        e.where(part).drop("half").write.mode("append").parquet(source)
        stream = logs.read_stream(spark, source, "rule_id string, ts double, value double", "parquet")
        closed = logs.run_once(logs.rule_windows(stream, 86400, "0 seconds"), folder)
    return closed.select("rule_id", "window", "n", "total")


# --- identifiers and sealing -----------------------------------------------------------------------------------------------------
GROUP = "lpad(to_base(('0x' || substr(h, {0}, 5))::bigint, 32), 4, '0')"
B32 = "translate(upper(concat(" + ", ".join(GROUP.format(5 * i + 1) for i in range(6)) + ")), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'abcdefghijklmnopqrstuvwxyz234567')"


@register(f"select p_partkey, concat('e_', {B32}) as entity_id from (select p_partkey, sha256(concat('part', chr(31), p_name)) as h from part)")
def b32_ids(spark, sf):
    return read(spark, sf, "part").select("p_partkey", ids.entity_id(F.lit("part"), F.col("p_name")).alias("entity_id"))


@register(f"select p_partkey, concat('ea_', {B32}) as addr from (select p_partkey, sha256(concat(p_name, chr(31), p_size::varchar, chr(31), (p_size + 5)::varchar)) as h from part)")
def evidence_addresses(spark, sf):
    return read(spark, sf, "part").select("p_partkey", ids.evidence_addr(F.col("p_name"), F.col("p_size"), F.col("p_size") + 5).alias("addr"))


WORD_SUMS = ", ',', ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::varchar" for i in range(8))


@register(
    f""", h as (select sha256(concat(strlen(subject)::varchar, ':', subject, strlen(predicate)::varchar, ':', predicate, strlen(object)::varchar, ':', object)) as h from dclaims where subject <> '' and predicate <> '' and object <> '')
select sha256(concat(count(*)::varchar, ',', {WORD_SUMS})) as topology_hash, count(*) as n_edges from h""",
    "dclaims",
)
def topology_hash(spark, sf):
    return graph.topology_hash(graph.edges(p.decision_claims(spark, sf)))


@register("select doc_id, strlen(text) + 28 as size, true as same, true as bound from documents")
def aes_roundtrip(spark, sf):
    """Nonce and tag add 28 bytes; the text comes back under its id and not under another."""
    key, aad = F.lit(b"0123456789abcdef0123456789abcdef"), F.col("doc_id").cast("string")
    c = read(spark, sf, "documents").select("doc_id", "text", aad.alias("aad"), F.aes_encrypt("text", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad).alias("c"))
    opened = lambda aad: F.try_aes_decrypt("c", key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")
    return c.select("doc_id", F.octet_length("c").cast("long").alias("size"), (opened(F.col("aad")) == F.col("text")).alias("same"), opened(F.concat("aad", F.lit("0"))).isNull().alias("bound"))


@register(
    """with recursive t(l) as (select list(unhex(sha256('\\x00'::blob || encode(doc_id::varchar || ':' || text))) order by doc_id) from documents union all
  select list_transform(range(1, (len(l) + 1) // 2 + 1), lambda k: case when 2 * k <= len(l) then unhex(sha256('\\x01'::blob || l[2 * k - 1] || l[2 * k])) else l[2 * k - 1] end) from t where len(l) > 1)
select lower(hex(l[1])) as root, (select count(*) from documents) as n_leaves from t where len(l) = 1"""
)
def merkle_root(spark, sf):
    return shards.merkle_tree(read(spark, sf, "documents").select("doc_id", F.concat_ws(":", "doc_id", "text").alias("leaf")), "doc_id", "leaf")


# --- the SQL surface ---------------------------------------------------------------------------------------------------------------
def _inherited(name: str, tables: str, spark_sql: str, oracle: str | None) -> None:
    def fn(spark, sf):
        for t in tables.split():
            read(spark, sf, t).createOrReplaceTempView(f"cl_{t}")
        return spark.sql(spark_sql)

    fn.__name__ = name
    register(oracle)(fn)


def _both(name: str, tables: str, sql: str) -> None:
    """One text for both dialects; tables are written {table}."""
    names = tables.split()
    _inherited(name, tables, sql.format(**{t: f"cl_{t}" for t in names}), sql.format(**{t: t for t in names}))


_both("inherited_rollup", "lineitem", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as qty from {lineitem} group by rollup (l_returnflag, l_linestatus)")
_both("inherited_cube", "orders", "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by cube (o_orderstatus, o_orderpriority)")
_both("inherited_grouping_sets", "orders", "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
_both("inherited_having", "orders", "select o_custkey, count(*) as n from {orders} group by o_custkey having count(*) > 12")
_both("inherited_filter", "events", "select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) as n from {events} group by user_id")
_both("inherited_ranking", "orders", "select o_custkey, o_orderkey, cast(row_number() over w as bigint) as rn, cast(rank() over w as bigint) as rk, cast(dense_rank() over w as bigint) as dr, cast(ntile(4) over w as bigint) as nt from {orders} window w as (partition by o_custkey order by o_orderkey)")
_both("inherited_lag_lead", "events", "select event_id, lag(event_id, 1) over w as before, lead(event_id, 2, -1) over w as after, first_value(event_id) over w as first from {events} window w as (partition by user_id order by event_id)")
_both("inherited_frames", "orders", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as n3, cast(sum(o_custkey) over (partition by o_custkey order by o_orderkey range between 1000 preceding and current row) as bigint) as near from {orders}")
_both("inherited_semi", "customer orders", "select c_custkey from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey and o_orderstatus = 'F')")
_both("inherited_anti", "customer orders", "select c_custkey from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
_both("inherited_intersect", "lineitem part", "select l_partkey as k from {lineitem} intersect select p_partkey from {part} where p_size > 25")
_both("inherited_except_all", "orders customer", "select o_custkey as k from {orders} except all select c_custkey from {customer}")
_both("inherited_full_join", "supplier nation", "select n_name, s_suppkey from {supplier} full join {nation} on s_nationkey = n_nationkey and n_regionkey = 1")
_both("inherited_lateral", "nation customer", "select n.n_name, x.n from {nation} n, lateral (select count(*) as n from {customer} c where c.c_nationkey = n.n_nationkey) x")
_both("inherited_correlated", "part lineitem", "select p_partkey, (select count(*) from {lineitem} where l_partkey = p_partkey) as n from {part}")
_both("inherited_recursive", "region", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 10) select n, (select count(*) from {region}) as regions from t")
_both("inherited_median", "part", "select p_brand, median(p_size) as mid, max_by(p_partkey, p_partkey) as last from {part} group by p_brand")
_inherited("inherited_pivot", "orders", "select * from (select o_orderstatus, o_orderpriority from cl_orders) pivot (count(*) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by o_orderpriority")
_inherited("inherited_qualify", "orders", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from cl_orders) where k = 1", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
_inherited("inherited_distinct_on", "events", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) as k from cl_events) where k = 1", "select distinct on (user_id) user_id, event_id from events order by user_id, event_id")
_inherited("inherited_string_agg", "nation", "select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from cl_nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")
_inherited("inherited_approx_distinct", "lineitem", "select approx_count_distinct(l_partkey) as n from cl_lineitem", None)
_inherited("inherited_exclude", "nation", "select * except (n_regionkey) from cl_nation", "select * exclude (n_regionkey) from nation")


@register(
    """select e.event_id, max(o.event_id) as last_order from events e left join events o on o.user_id = e.user_id and o.event_type = 'purchase' and o.event_id <= e.event_id group by e.event_id"""
)
def inherited_asof(spark, sf):
    """As-of join by one sort: the last purchase of the same user at or before each event."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    purchase = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return read(spark, sf, "events").select("event_id", F.last(purchase, True).over(order).alias("last_order"))


@register("select n_nationkey as k, n_name as name, null as other from nation union all by name select r_regionkey as k, r_name as other from region")
def inherited_union_by_name(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("other"))
    return n.unionByName(r, allowMissingColumns=True)

from claimlake.plans import stores, tables  # noqa: E402, F401  they register queries too
