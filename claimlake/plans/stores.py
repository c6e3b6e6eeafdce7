r"""Queries over what the tables are written to and read back from: sealed shards, files of many formats, chat exports,
logs. The SQL says what has to come back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from claimlake import registry
from claimlake.functions import ids
from claimlake.operators import asking, derive, emit, extract, resolve
from claimlake.plans import tables
from claimlake.plans.projections import read
from claimlake.plans.registered import ORACLES, register
from claimlake.plans.tables import text, view
from claimlake.runtime import delete, scratch, tidy, written
from claimlake.session import Session
from claimlake.sources import chat, documents, envelope, shards


# --- sealed shards ---------------------------------------------------------------------------------------------------
def _claims():
    entity = F.col("pos") % 2 == 0
    said = F.when(entity, F.concat(F.lit("source:"), "source")).otherwise(F.col("line"))
    return F.concat(F.lit("lang:"), "lang").alias("subject"), F.lit("has_line").alias("predicate"), said.alias("object"), F.when(entity, "entity").otherwise("literal:string").alias("object_type")


def _session(spark, sf) -> Session:
    """Lines of documents of even and of odd ids, compiled into a shard each, verified and mounted. A text that is in both
    is a span of both."""
    docs = read(spark, sf, "documents")
    session = Session(spark)
    for rest in (0, 1):
        own = docs.where(F.col("doc_id") % 2 == rest)
        ls = extract.lines(own, "lang", "source").where("line <> ''")
        said = ls.select("doc_id", *_claims(), F.col("line").alias("evidence"), "byte_start", "byte_end", (F.col("pos") % 4).alias("tier"))
        path = f"{scratch(spark)}/shard"
        shards.compile_shard(said, own.select("doc_id", "text"), path, namespace=f"lines{rest}")
        session.mount(path)
    return session


SAID = "said as (select doc_id % 2 as half, concat('lang:', lang) as subject, 'has_line' as predicate, case when pos % 2 = 0 then concat('source:', source) else line end as object, case when pos % 2 = 0 then 'entity' else 'literal:string' end as object_type, pos % 4 as tier, source_hash, byte_start, byte_end, line from dl)"


@register(f", {SAID} select subject, predicate, object, min(tier)::int as tier from said group by half, subject, predicate, object, object_type", "dl")
def session_claims(spark, sf):
    return _session(spark, sf).sql("select subject, predicate, object, tier from claims_resolved")


@register(f", {SAID} select subject, predicate, object, byte_start, byte_end, line as evidence from (select distinct half, subject, predicate, object, object_type, source_hash, byte_start, byte_end from said) join (select distinct half as mounted, source_hash, byte_start, byte_end, line from said) using (source_hash, byte_start, byte_end)", "dl")
def session_provenance(spark, sf):
    return _session(spark, sf).provenance().select("subject", "predicate", "object", "byte_start", "byte_end", "evidence")


@register(f", {SAID} select half, 'claims' as name, count(*) as n from (select distinct half, subject, predicate, object, object_type from said) group by half union all select half, 'spans', count(*) from (select distinct half, source_hash, byte_start, byte_end, line from said) group by half union all select half, 'entities', count(*) from (select half, subject from said union select half, object from said where object_type = 'entity') group by half", "dl")
def mounted_tables(spark, sf):
    session = _session(spark, sf)
    order = {m.shard_id: i for i, m in enumerate(session.mounts.values())}  # mounted in this order
    half = F.coalesce(*[F.when(F.col("shard_id") == k, F.lit(i).cast("long")) for k, i in order.items()])
    parts = [session.table(t).groupBy(half.alias("half")).agg(F.count("*").alias("n")).withColumn("name", F.lit(t)) for t in ("claims", "spans", "entities")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(f", {SAID} select distinct subject, predicate, object, byte_start, byte_end, line as evidence from said", "dl")
def envelope_claims(spark, sf):
    """A shard of all lines, sealed under two colours, opened again, verified and mounted. What the next step has taken over is
    removed, table by table, so the shard is on disk once, and beside it the table that is sealed or opened."""
    docs, secret = read(spark, sf, "documents").withColumn("source_hash", ids.source_hash(F.col("text"))), b"a secret of this query"
    ls = extract.lines(docs, "lang", "source", "source_hash").where("line <> ''")
    said = ls.select("doc_id", "source_hash", *_claims(), F.col("line").alias("evidence"), "byte_start", "byte_end", (F.col("pos") % 4).alias("tier"))
    folder = scratch(spark)
    with tidy(spark):
        shards.compile_shard(said, docs.select("doc_id", "text"), f"{folder}/shard", namespace="lines")
        envelope.seal(spark, f"{folder}/shard", f"{folder}/sealed", secret, {"content/": "Red"}, consume=True)
        delete(spark, f"{folder}/shard")
        opened = envelope.open_envelope(spark, f"{folder}/sealed", secret, f"{folder}/open", consume=True)
        delete(spark, f"{folder}/sealed")
        session = Session(spark)
        mount = session.mount(opened)
        delete(spark, f"{opened}/content")  # spans are checked against it by now
        claims, entities, provenance, spans = (session.table(t) for t in ("claims", "entities", "provenance", "spans"))
        # Hashes of sources go as bytes, half their digits, with each text that meets them.
        narrow = lambda df: df.withColumn("source_hash", F.unhex("source_hash"))
        once = written(resolve.said_once(claims, entities, narrow(provenance), narrow(spans)), "once")
        answer = resolve.evidence_once(once, claims, entities, narrow(spans))
    session.unmount(mount.mount_id)
    delete(spark, f"{opened}/graph/provenance.parquet")  # ``once`` has taken it over
    return answer


# --- files ---------------------------------------------------------------------------------------------------------------
KINDS = ("txt", "md", "html", "csv", "tsv", "xml", "ics", "rss", "json", "xbrl", "exe")
CR, LF, TAB = "chr(13)", "chr(10)", "chr(9)"
CONTENT = f"""case p_partkey % 11 when 0 then concat(p_name, ' é') when 1 then concat('# ', p_name) when 2 then concat('<html><script>no</script><nav>no</nav><h1>', p_name, '</h1><p>One <b>', p_brand, '</b></p></html>')
  when 3 then concat('name,brand', {LF}, p_name, ',', p_brand, {LF}) when 4 then concat('name', {TAB}, 'type', {LF}, p_name, {TAB}, p_type, {LF}) when 5 then concat('<a>x <b>', p_name, '</b> </a>')
  when 6 then concat('BEGIN:VEVENT', {CR}, {LF}, 'SUMMARY:Meet ', p_name, {CR}, {LF}, 'DTSTART;TZID=X:', {text('p_size')}, {CR}, {LF}, 'LOCATION:Room', {CR}, {LF}, ' 1', {CR}, {LF}, 'END:VEVENT')
  when 7 then concat('<rss><item><title>', p_name, '</title><pubDate>Mon</pubDate><description>', p_brand, '</description></item></rss>') when 8 then concat('{{{{"a":', {text('p_size')}, '}}}}')
  when 9 then concat('<x><EntityRegistrantName contextRef="c">', p_brand, '</EntityRegistrantName><NetIncome contextRef="c" unitRef="USD">', {text('p_size')}, '</NetIncome><context>c</context></x>') else 'MZ' end"""
NAMED = "case p_partkey % 11 " + " ".join(f"when {i} then concat('f', {text('p_partkey')}, '.{k}')" for i, k in enumerate(KINDS)) + " end"
PLAIN = CONTENT.replace("{{", "{").replace("}}", "}")


def _files(spark, sf):
    return view(spark, sf, "part", f"select {NAMED} as path, {NAMED} as name, cast({CONTENT} as binary) as content from {{part}}")


@register(
    f"""with f as (select *, {NAMED} as path, {PLAIN} as content, p_partkey % 11 as k from part)
select path, 0 as block_idx, case k when 2 then p_name when 5 then concat('x ', p_name) when 6 then concat('SUMMARY:Meet ', p_name, {CR}, {LF}, 'DTSTART;TZID=X:', {text('p_size')}, {CR}, {LF}, 'LOCATION:Room1') when 7 then concat(p_name, {LF}, p_brand)
  when 8 then concat('{{', {LF}, '  "a": ', {text('p_size')}, {LF}, '}}') when 9 then concat('EntityRegistrantName: ', p_brand, {LF}, 'NetIncome: ', {text('p_size')}, ' USD') when 10 then null else content end as text, k = 10 as failed from f
union all select path, 1, concat('One ', p_brand), false from f where k = 2"""
)
def file_blocks(spark, sf):
    return documents.blocks(_files(spark, sf)).select("path", "block_idx", "text", F.col("error").isNotNull().alias("failed"))


@register(
    f"""with f as (select *, {NAMED} as path, p_partkey % 11 as k from part)
select path, p_name as subject, 'brand' as predicate, p_brand as object, concat('brand: ', p_brand) as evidence from f where k = 3 union all select path, p_name, 'type', p_type, concat('type: ', p_type) from f where k = 4
union all select path, concat('Meet ', p_name), 'scheduled_at', {text('p_size')}, concat('Meet ', p_name, ': ', {text('p_size')}) from f where k = 6 union all select path, concat('Meet ', p_name), 'located_at', 'Room1', concat('Meet ', p_name, ': Room1') from f where k = 6
union all select path, p_name, 'published_at', 'Mon', concat(p_name, ': Mon') from f where k = 7
union all select path, p_brand, 'entity_registrant_name', p_brand, concat('EntityRegistrantName: ', p_brand) from f where k = 9 union all select path, p_brand, 'net_income', concat({text('p_size')}, ' USD'), concat('NetIncome: ', {text('p_size')}, ' USD') from f where k = 9"""
)
def file_candidates(spark, sf):
    return documents.lifted(_files(spark, sf)).select("path", "subject", "predicate", "object", "evidence")


@register(f"select {NAMED} as file_name, {PLAIN} as text from part")
def file_texts(spark, sf):
    return documents.ingest(_files(spark, sf)).select("file_name", "text")


@register(f"select count(*) as n_files, sum(strlen({PLAIN}))::bigint as n_bytes, sum(len(string_split({PLAIN}, {LF})))::bigint as n_lines, greatest(1, sum(len(string_split({PLAIN}, {LF}))) * 2 // 20)::bigint as n_chunks from part")
def file_plan(spark, sf):
    return documents.plan_job(_files(spark, sf).withColumn("length", F.octet_length("content").cast("long"))).drop("seconds")


# --- chat exports --------------------------------------------------------------------------------------------------------
def _exports(spark, sf):
    """A file for each conversation, by its id in one of four shapes."""
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    pos = lambda i: i.cast("string")
    title = F.concat(F.lit("talk "), F.col("conv_id").cast("string"))
    first = F.lit("2024-01-02T03:04:05.000000+00:00")
    claude = F.array(F.struct(F.lit("u").alias("uuid"), title.alias("name"), first.alias("created_at"), F.transform("t", lambda m: F.struct(m["role"].alias("sender"), m["text"].alias("text"), first.alias("created_at"))).alias("chat_messages")))
    flat = F.array(F.struct(title.alias("title"), F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")))
    message = lambda m, i: F.struct(F.struct(m["role"].alias("role")).alias("author"), F.struct(F.array(m["text"]).alias("parts")).alias("content"), (i + 60).cast("double").alias("create_time"))
    nodes = F.map_from_entries(F.transform("t", lambda m, i: F.struct(F.concat(F.lit("n"), pos(i)), F.struct(F.when(i > 0, F.concat(F.lit("n"), pos(i - 1))).alias("parent"), message(m, i).alias("message")))))
    tree = F.array(F.struct(title.alias("title"), F.lit(60.0).alias("create_time"), nodes.alias("mapping")))
    generic = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    kind = F.col("conv_id") % 4
    return turns.select(F.col("conv_id").cast("string").alias("path"), F.when(kind == 0, F.to_json(claude)).when(kind == 1, F.to_json(flat)).when(kind == 2, F.to_json(tree)).otherwise(F.to_json(generic)).alias("text"))


@register(
    """select conv_id::varchar as path, case conv_id % 4 when 0 then 'chat_claude' when 3 then 'chat_generic' else 'chat_openai' end as format, case when conv_id % 4 < 3 then concat('talk ', conv_id::varchar) end as title, pos::int as pos, role, text,
  case conv_id % 4 when 0 then '2024-01-02T03:04:05Z' when 2 then strftime(make_timestamp((pos + 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') end as ts
from (select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as pos from conversations) where trim(coalesce(text, '')) <> ''"""
)
def chat_exports(spark, sf):
    return chat.turns(_exports(spark, sf)).select("path", "format", "title", F.col("pos").cast("int").alias("pos"), "role", "text", "ts")


# --- answers that are kept --------------------------------------------------------------------------------------------
def _line_model(text: str) -> str:
    """A stand-in for a model: of a text's first and last lines a claim each, and one whose quote is not in the text."""
    ls = text.split("\n")
    return json.dumps({"claims": [{"subject": "first", "quote": ls[0]}, {"subject": "last", "quote": ls[-1], "confidence": 0.75}, {"subject": "none", "quote": text + "x"}]})


@register(
    """with c as (select doc_id, text, unnest([{'s': 'first', 'q': string_split(text, chr(10))[1], 'p': 0.5}, {'s': 'last', 'q': string_split(text, chr(10))[-1], 'p': 0.75}], recursive := true) from documents where length(text) >= 50),
t as (select *, regexp_replace(q, '^\\s+|\\s+$', '', 'g') as quote from c)
select doc_id, s as subject, 'related_to' as predicate, p as confidence, quote, strpos(text, quote) - 1 as start, strpos(text, quote) - 1 + length(quote) as end, ((length(text) - length(replace(text, quote, ''))) // length(quote))::bigint as n_found from t where quote <> ''"""
)
def extracted_quotes(spark, sf):
    """Whole texts are asked about in two runs on one folder: the second asks what the first has not."""
    docs = read(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_id"), "text")
    folder = f"{scratch(spark)}/answers"
    asking.ask(docs.where("doc_id % 2 = 0 and length(text) >= 50").select(F.col("text").alias("prompt")), _line_model, folder)
    found = asking.extracted(docs, _line_model, folder)
    return found.select("doc_id", "subject", "predicate", "confidence", "quote", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("n_found").cast("long").alias("n_found"))


# --- logs and extensions ------------------------------------------------------------------------------------------------
def _log(spark, sf) -> str:
    path = f"{scratch(spark)}/log"
    line = F.to_json(F.struct("event_id", "event_type"))
    read(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(line)).write.text(path)
    return path


@register("select event_id, event_type from events where event_id % 10 <> 3")
def log_rows(spark, sf):
    return documents.read_log(spark, _log(spark, sf), "event_id long, event_type string")


@register("select concat('{broken ', event_id::varchar) as line from events where event_id % 10 = 3")
def log_malformed(spark, sf):
    return documents.malformed_lines(spark, _log(spark, sf), "event_id long, event_type string")


@register("select doc_id, pos, line as evidence from dl", "dl")
def candidates_file(spark, sf):
    path = f"{scratch(spark)}/candidates"
    emit.candidates_to_json(extract.lines(read(spark, sf, "documents")).where("line <> ''").select("doc_id", "pos", F.col("line").alias("evidence")), path)
    return documents.read_log(spark, path, "doc_id long, pos int, evidence string")


@register(ORACLES["temporal_derive"])
def temporal_extension(spark, sf):
    path = f"{scratch(spark)}/temporal@1.parquet"
    claims = view(spark, sf, "orders", f"select o_orderkey as claim_id, 'said' as predicate, {tables.SAID} as object from {{orders}}")
    emit.extension_to_parquet(derive.temporal(claims), path, ["claim_id"])
    return spark.read.parquet(path)


PASSES = {"tier0_markdown": 3, "tier0_statutory": 1, "tier0_cases": 1, "tier0_blockquotes": 1, "tier0_headings": 2, "tier1_crossref": 1}


@register(" union all ".join(f"select '{name}' as generator, {i} as pass, {n} * count(*)::bigint as n from part" for i, (name, n) in enumerate(PASSES.items())))
def generators(spark, sf):
    found = registry.run(view(spark, sf, "part", tables.MARKDOWN, deal=True), list(PASSES))
    return found.groupBy("generator", F.col("pass")).agg(F.count("*").alias("n"))
