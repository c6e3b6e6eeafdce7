"""Small examples of single operators, with the rows that they must give."""

import duckdb
import pytest
from claimlake.functions import scalar
from claimlake.operators import bind, chunk, constraints, decisions, derive, extract, firewall
from pyspark.sql import functions as F

EXAMPLES = {}


def register(sql=None):
    def add(fn):
        EXAMPLES[fn.__name__] = fn, sql
        return fn

    return add


def rows(spark, schema, values):
    return spark.createDataFrame(values, schema)


RULE_ROWS = [
    ("k1", "Patrol Alpha ROE", "PROHIBITS", "fire on bridge", "s1"), ("k2", "FSCM zone", "PERMITS", "artillery", "s1"), ("k3", "recon", "REQUIRES", "approval", "s2"), ("k4", "general guidance", "APPLIES_TO", "", "s2"),
    ("k5", "cmdr", "DELEGATES_TO", "JFC", "s1"), ("k6", "JFC", "DELEGATES_TO", "CCDR", "s1"), ("k7", "CCDR", "DELEGATES_TO", "cmdr", "s2"), ("k8", "hq", "REVOKES", "Rogue", "s2"), ("k9", "ACM corridor", "PERMITS", "flight", "s3"),
]
REQUEST_ROWS = [("q1", "cmdr", "fire", "bridge"), ("q2", "rogue", "artillery", "hill"), ("q3", "pilot", "flight", "corridor"), ("q4", "JFC", "recon", "valley"), ("q5", "clerk", "write", "memo")]


def _values(name: str, columns: str, values: list[tuple]) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in values) + ")"


RULE_CTES = "with " + _values("claims", "claim_id, subject, predicate, object, shard_id", RULE_ROWS) + ", " + _values("requests", "request_id, actor, action, target", REQUEST_ROWS)
KIND = "case " + " ".join(f"when contains(s, '{k.lower()}') or contains(o, '{k.lower()}') then '{k}'" for k in constraints.PRECEDENCE[:-1]) + " else 'GUIDANCE' end"
MATCHES = f"""select request_id, claim_id, shard_id, predicate, {KIND} as constraint_type from (
  select r.*, c.claim_id, c.shard_id, c.predicate, lower(c.subject) as s, lower(c.object) as o, lower(r.action) as a, lower(r.target) as t
  from requests r join claims c on c.predicate in ('PROHIBITS', 'PERMITS', 'REQUIRES', 'APPLIES_TO'))
where contains(s, a) or contains(o, a) or contains(s, t) or contains(o, t) or contains(a, s) or contains(t, o)"""


def _rules(spark):
    return rows(spark, "claim_id string, subject string, predicate string, object string, shard_id string", RULE_ROWS)


def _requests(spark):
    return rows(spark, "request_id string, actor string, action string, target string", REQUEST_ROWS)


@register(RULE_CTES + "\n" + MATCHES)
def constraint_matches(spark, sf):
    return constraints.matches(_requests(spark), _rules(spark)).drop("match_reason", "weight")


@register(
    RULE_CTES
    + f""", m as ({MATCHES}), ranked as (
  select *, row_number() over (partition by request_id order by (constraint_type <> 'FSCM')::int, list_position({list(constraints.PRECEDENCE)}, constraint_type), shard_id, claim_id) as k, count(*) over (partition by request_id) as n_matches from m),
revoked as (select upper(object) as who from claims where predicate = 'REVOKES')
select r.request_id, case when m.claim_id is null or upper(r.actor) in (select who from revoked) then 'deny' when m.predicate = 'PROHIBITS' then 'deny' when m.predicate = 'PERMITS' then 'permit' else 'conditional' end as status,
  m.claim_id as controlling_constraint, m.constraint_type, coalesce(m.n_matches, 0)::bigint as n_matches
from requests r left join ranked m on m.request_id = r.request_id and m.k = 1"""
)
def constraint_decision(spark, sf):
    return constraints.decide(_requests(spark), _rules(spark)).drop("chain", "notes", "confidence")


@register(
    "with recursive " + (RULE_CTES.removeprefix("with ")) + """, d as (select subject, arg_max(object, (shard_id, claim_id)) as object from claims where predicate = 'DELEGATES_TO' group by subject),
w(actor, cur, depth, path, stop) as (select distinct actor, actor, 0, [actor], false from requests union all
  select w.actor, d.object, w.depth + 1, case when list_contains(w.path, d.object) then w.path else list_append(w.path, d.object) end, list_contains(w.path, d.object) from w join d on d.subject = w.cur where not w.stop)
select actor, array_to_string(arg_max(path, (len(path), depth)), '>') as chain, bool_or(stop) as cycle from w group by actor"""
)
def authority_chain(spark, sf):
    return constraints.authority_chain(_requests(spark), _rules(spark)).withColumn("chain", F.array_join("chain", ">"))



MARKDOWN = (
    "## NODE 1: Support\n\n### *Marriage of Smith* order\nUnder Family Code § 2040 a party must file. See *In re Marriage of Feldman* (153 Cal.App.4th 1470) for it.\n\n"
    "| Name | Due Date | Sum |\n|---|:-:|---|\n| Rent | 2024-03-01 | $1,200.50 |\n| Food |  | $30 |\n\n> The court held that disclosure duties continue until judgment.\n\nPaid $1,234.56 on 2024-03-01 and March 5, 2024. Pursuant to § 271 sanctions follow. *Feldman* applies § 271 strictly."
)


@register()
def markdown_candidates(spark, sf):
    docs = rows(spark, "doc_id long, text string", [(1, MARKDOWN)])
    parts = [extract.markdown_tables, extract.headings, extract.statute_mentions, extract.case_citations, extract.blockquotes, extract.cross_references, extract.case_interpretations]
    found = [extract.in_source(f(docs), docs) for f in parts]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@register("select * from (values (1, 0, 'money', '$1,234.56'), (1, 0, 'date', '2024-03-01'), (1, 1, 'date', 'March 5, 2024')) t(doc_id, k, kind, value)")
def tier1_mentions(spark, sf):
    chunks = rows(spark, "doc_id int, chunk_id string, text string", [(1, "1:0", "Paid $1,234.56 on 2024-03-01 and March 5, 2024")])
    return extract.mentions(chunks).select("doc_id", "k", F.replace("predicate", F.lit("mentions_"), F.lit("")).alias("kind"), "value")


OBJECTS = ["yes", "42", "1999", "3.14", "5 mg", "1/2/2024", "Jan 5, 2024", "Aspirin", "", "-7", "12 %", "TRUE"]


@register(
    "with " + _values("o", "object", [(x,) for x in OBJECTS]) + r""" select object, case when trim(object) = '' then 'entity' when regexp_matches(object, '(?i)^(true|false|yes|no)$') then 'literal:boolean' when regexp_matches(object, '^-?\d{1,15}$') then 'literal:integer'
 when regexp_matches(object, '^-?\d+\.\d+$') then 'literal:decimal' when regexp_matches(object, '(?i)^-?\d[\d,.]*\s*(%|mg)s?$') or regexp_matches(object, '(?i)^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|Jan\w*\s+\d{1,2},?\s+\d{4})$') then 'literal:string' else 'entity' end as object_type from o"""
)
def object_types(spark, sf):
    return rows(spark, "object string", [(x,) for x in OBJECTS]).withColumn("object_type", scalar.object_type(F.col("object")))


LABELS = ["it", "The study", "WHO", "x", "X", "", "Aspirin", "several"]


@register("select * from (values ('it', true), ('The study', true), ('WHO', false), ('x', true), ('X', false), ('', true), ('Aspirin', false), ('several', true)) t(label, garbage)")
def garbage_entities(spark, sf):
    return rows(spark, "label string", [(x,) for x in LABELS]).withColumn("garbage", scalar.is_garbage_entity(F.col("label")))


RAW = [
    (0, "WHO backs aspirin", "WHO", "backs", "Aspirin", [0, 1], False), (1, "dose", "aspirin", "dose is", "5 mg", [3], False), (2, "gap", "aspirin", None, None, [0, 2], False), (3, "none", "aspirin", "is", "x", [99], False),
    (4, None, None, None, None, [], True), (5, "vague", "it", "is", "good", [1], False), (6, "WHO backs aspirin", "who", "backs", "aspirin", [1, 0], False), (7, "both", "WHO", "says", "the study", [2, 3], False),
]
SOURCE = "The World Health Organization (WHO) met. It backs aspirin. Costs fell. The dose is 5 mg."


def _bound(spark):
    raw = rows(spark, "doc_id int, pos int, claim_text string, subject string, predicate string, object string, sentence_ids array<int>, progress boolean", [(1, *r) for r in RAW])
    source = rows(spark, "doc_id int, text string", [(1, SOURCE)])
    sentences = chunk.sentences(source)
    return raw, sentences, bind.bind(raw, sentences, source)


@register("select * from (values (0, 0, 58, 'World Health Organization', 'backs', 'aspirin', 'entity'), (1, 71, 88, 'aspirin', 'dose is', '5 mg', 'literal:string'), (2, 0, 40, 'aspirin', 'relates to', 'gap', 'entity'), (2, 59, 70, 'aspirin', 'relates to', 'gap', 'entity'), (7, 59, 88, 'World Health Organization', 'says', 'the study', 'literal:string')) t(pos, byte_start, byte_end, subject, predicate, object, object_type)")
def bind_candidates(spark, sf):
    return _bound(spark)[2].select("pos", F.col("byte_start").cast("int").alias("byte_start"), F.col("byte_end").cast("int").alias("byte_end"), "subject", "predicate", "object", "object_type")


@register("select * from (values ('progress', 1::bigint), ('no_valid_ids', 1::bigint), ('emitted', 4::bigint), ('garbage_or_repeated', 2::bigint)) t(reason, n)")
def bind_counters(spark, sf):
    return bind.bind_report(*_bound(spark))


@register("select lower(form) as key, arg_max(form, (n, -reached)) as canonical from (select form, count(*) as n, max(pos) as reached from (values (1, 'Aspirin'), (2, 'aspirin'), (3, 'aspirin'), (4, 'Rome'), (5, 'rome')) t(pos, form) group by form) group by lower(form)")
def case_voting(spark, sf):
    labels = rows(spark, "doc_id int, pos int, label string", [(0, 1, "Aspirin"), (0, 2, "aspirin"), (0, 3, "aspirin"), (0, 4, "Rome"), (0, 5, "rome")])
    return bind.canonical_forms(labels, rows(spark, "doc_id int, acronym string, full_name string", [])).drop("doc_id")


@register("select * from (values (1::bigint, 'k1', 'e1'), (3::bigint, 'k2', 'e2')) t(ordinal, subject, evidence)")
def greedy_merge(spark, sf):
    c = rows(spark, "doc_id int, ordinal long, subject string, predicate string, object string, evidence string", [(1, 1, "k1", "p", "o", "e1"), (1, 2, "k1", "p", "o", "e1"), (1, 3, "k2", "p", "o", "e2"), (1, 4, "k3", "p", "o", "e1")])
    return bind.greedy_merge(c).select("ordinal", "subject", "evidence")



DATES = ["2024-01-02", "01/31/2024", "31/01/2024", "31-01-2024", "2024/01/31", "2024-01-02T03:04:05Z", "none"]


@register("select * from (values ('2024-01-02', '2024-01-02T00:00:00Z'), ('01/31/2024', '2024-01-31T00:00:00Z'), ('31/01/2024', '2024-01-31T00:00:00Z'), ('31-01-2024', ''), ('2024/01/31', ''), ('2024-01-02T03:04:05Z', '2024-01-02T00:00:00Z')) t(claim_id, valid_from)")
def temporal_derive(spark, sf):
    claims = rows(spark, "claim_id string, predicate string, object string", [(x, "said", x) for x in DATES])
    return derive.temporal(claims).select("claim_id", "valid_from")



NAMES = {"Net Income": (7, 2, 20), "fiscal year": (6, 1, 1), "5 mg dose": (7, 3, 1), "Paris hospital": (5, 3, 1), "payment transfer": (2, 1, 1), "policy": (8, 1, 1), "patient": (1, 2, 1), "Acme inc": (1, 1, 1), "zzz": (8, 4, 1)}


@register("select * from (values " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in NAMES.items()) + ") t(label, major, type, subtype)")
def coords_labels(spark, sf):
    return rows(spark, "label string", [(k,) for k in NAMES]).select("label", scalar.coordinates(F.col("label")).alias("c")).select("label", "c.*")



ANSWER = "A long factual sentence without cite. Short. Based on x we say no more. Fact one here [1]. Fact two here [9, 1]. Really?"


@register("select * from (values (0, 'uncited', ''), (1, 'pass', ''), (2, 'pass', ''), (3, 'verified', '1'), (4, 'fabricated', '1,9'), (5, 'pass', '')) t(pos, status, cites)")
def firewall_check(spark, sf):
    a = rows(spark, "answer_id int, answer string, valid_ids array<int>", [(1, ANSWER, [1])])
    return firewall.check(a).select("pos", "status", F.array_join(F.col("cites").cast("array<string>"), ",").alias("cites"))


@register("select 1 as answer_id, 1::bigint as n_uncited, 1::bigint as n_fabricated, false as clean")
def firewall_verdict(spark, sf):
    return firewall.verdict(firewall.check(rows(spark, "answer_id int, answer string, valid_ids array<int>", [(1, ANSWER, [1])])))


@register("select * from (values ('query:i1', 'was_answered_by', 'yes it is', -1), ('query:i1', 'cites_claim', 'c1', 0)) t(subject, predicate, object, pos)")
def decision_candidates(spark, sf):
    cite = {"claim_id": "c1", "id": None, "shard_id": "s", "subject": "a", "subject_label": None, "predicate": "p", "object": "b", "object_label": None}
    log = rows(spark, decisions.SCHEMA, [("i1", 1.0, "is it?", "yes\nit is", [cite, {**cite, "claim_id": None}], "s", {}), ("i2", 2.0, "q", "a", [], "s", {})])
    return decisions.candidates(log).select("subject", "predicate", "object", "pos")


@pytest.mark.parametrize("name", EXAMPLES)
def test_example(name, spark, sf):
    fn, sql = EXAMPLES[name]
    df = fn(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got
    if sql:
        found = duckdb.sql(sql)
        at = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == columns and got == sorted(tuple(r[i] for i in at) for r in found.fetchall())
