"""Sessions over compiled shards: compile, verify, seal, open, mount, ask."""

import json
import shutil
from pathlib import Path

import pytest
from claimlake import schema
from claimlake.functions import ids
from claimlake.operators import chunk, derive, nlq
from claimlake.plans import gate
from claimlake.session import Chat, Session
from claimlake.sources import envelope, shards

TEXT = "Aspirin treats pain. Ibuprofen treats fever. Café closes at noon."
CANDIDATES = [
    (1, "Aspirin", "treats", "pain", "entity", "Aspirin treats pain.", 0, 20, 0),
    (1, "Ibuprofen", "treats", "fever", "entity", "Ibuprofen treats fever.", 21, 44, 1),
    (1, "Café", "closes at", "noon", "literal:string", "Café closes at noon.", 45, 66, 2),
]
COLUMNS = "doc_id long, subject string, predicate string, object string, object_type string, evidence string, byte_start long, byte_end long, tier int"


@pytest.fixture(scope="module")
def shard(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("store") / "one")
    candidates = spark.createDataFrame(CANDIDATES, COLUMNS)
    sources = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    refs = spark.createDataFrame([("c", "cites", "shard_x", "shard", "shard_x", 0.5, None)], schema.EXTENSIONS["references"])
    shards.compile_shard(candidates, sources, out, extensions={"references@1": refs}, key=b"k")
    return out


@pytest.fixture
def copy(shard, tmp_path):
    return shutil.copytree(shard, tmp_path / "copy")


def test_compiled_shard_verifies_and_its_bytes_prove_its_claims(spark, shard):
    shards.verify(spark, shard, b"k")
    s = Session(spark, key=b"k")
    s.mount(shard)
    rows = s.provenance().collect()
    assert {r["subject"] for r in rows} == {"Aspirin", "Ibuprofen", "Café"}
    for r in rows:
        assert TEXT.encode()[r["byte_start"] : r["byte_end"]].decode() == r["evidence"]


def _damage(spark, path: Path, code: str) -> None:
    manifest = json.loads((path / "manifest.json").read_text())
    if code == "MANIFEST":
        (path / "manifest.json").write_text(json.dumps({**manifest, "spec_version": "9"}))
    elif code == "LAYOUT":
        shutil.rmtree(path / "evidence")
    elif code == "SOURCE":
        from pyspark.sql import functions as F

        where = path / "content" / "sources.parquet"
        df = spark.read.parquet(str(where)).withColumn("text", F.lit("other"))
        rows = spark.createDataFrame(df.collect(), df.schema)
        shutil.rmtree(where)
        rows.write.parquet(str(where))
    elif code == "MERKLE":
        (path / "content" / "more.txt").write_text("x")
    elif code == "SIGNATURE":
        (path / "sig" / "manifest.hmac").write_text("0")


@pytest.mark.parametrize("code", ["MANIFEST", "LAYOUT", "SOURCE", "MERKLE", "SIGNATURE"])
def test_damage_is_named(spark, copy, code):
    _damage(spark, copy, code)
    with pytest.raises(shards.ShardError) as error:
        shards.verify(spark, str(copy), b"k")
    assert error.value.code == code


@pytest.mark.parametrize(("table", "change", "code"), [("provenance", "claim_id = 'c_none'", "ORPHAN"), ("claims", "claim_id = null", "NULL"), ("spans", "byte_end = 9999", "BOUNDS")])
def test_broken_tables_are_named(spark, copy, table, change, code):
    from pyspark.sql import functions as F

    column, value = change.split(" = ")
    where = copy / shards.PLACES[table] / f"{table}.parquet"
    df = spark.read.parquet(str(where)).withColumn(column, F.expr(value).cast(dict(x.split() for x in schema.CORE[table].split(", "))[column]))
    rows = spark.createDataFrame(df.collect(), df.schema)
    shutil.rmtree(where)
    rows.write.parquet(str(where))
    with pytest.raises(shards.ShardError) as error:
        shards.verify(spark, str(copy), b"k")
    assert error.value.code == code


def test_mounting_makes_views_and_unmounting_drops_them(spark, shard, tmp_path):
    s = Session(spark, catalog=str(tmp_path / "catalog.db"), audit=str(tmp_path / "audit.jsonl"))
    assert s.table("claims").count() == 0 and spark.sql("select * from temporal").count() == 0
    m = s.mount(shard)
    assert s.mount(shard) is m and len(s.mounts) == 1
    assert m.tables["references"].startswith("ext_references__")
    assert spark.sql("select * from refs").count() == 1 == spark.sql('select * from `references`').count()
    got = s.query_json("select subject, object from claims_resolved order by subject")
    assert got == {"columns": ["subject", "object"], "rows": [["Aspirin", "pain"], ["Café", "noon"], ["Ibuprofen", "fever"]]}
    assert s.catalog_json()[0]["mount_prefix"] == m.mount_prefix and s.health()["mounts"] == 1
    assert json.loads((tmp_path / "audit.jsonl").read_text().splitlines()[-1])["row_count"] == 3
    again = Session(spark, catalog=str(tmp_path / "catalog.db"))
    assert again.boot() == {"attempted": 1, "mounted": 1, "failed": 0}
    s.unmount(m.mount_id)
    s.unmount("unknown")
    assert s.table("claims").count() == 0
    assert Session(spark, catalog=str(tmp_path / "catalog.db")).boot()["attempted"] == 0


def test_chat_remembers_the_last_questions(spark, shard):
    s = Session(spark)
    s.mount(shard)
    chat = Chat(s, most=2)
    for question in ("find aspirin", "find café", "find aspirin"):
        answer = chat.ask(question)
    assert [r[0] for r in answer["rows"]] == ["Aspirin"] and len(chat.history) == 2


def test_envelope_round_trip_and_tampering(spark, shard, tmp_path):
    sealed = str(tmp_path / "sealed")
    head = envelope.seal(spark, shard, sealed, b"secret", {"content/": "Red"})
    assert {f["colour"] for f in head["files"]} == {"Green", "Red"} and any(f["path"] == "manifest.json" for f in head["files"])
    s = Session(spark, key=b"k")
    m = s.mount(sealed, b"secret", str(tmp_path / "open"))
    assert m.transport == "envelope" and s.table("claims").count() == 3
    with pytest.raises(shards.ShardError):
        envelope.open_envelope(spark, sealed, b"wrong", str(tmp_path / "no"))
    blob = next(Path(sealed, "blobs").iterdir())
    blob.write_bytes(blob.read_bytes()[:-1] + b"x")
    with pytest.raises(shards.ShardError):
        envelope.open_envelope(spark, sealed, b"secret", str(tmp_path / "no"))
    with pytest.raises(shards.ShardError):
        envelope.seal(spark, shard, str(tmp_path / "x"), b"s", {"": "Purple"})


def test_some_colours_only(spark, shard, tmp_path):
    sealed = str(tmp_path / "sealed")
    envelope.seal(spark, shard, sealed, b"secret", {"content/": "Red"})
    opened = Path(envelope.open_envelope(spark, sealed, b"secret", str(tmp_path / "o"), ("Green",)))
    assert (opened / "manifest.json").exists() and not (opened / "content").exists()


def test_secrets_are_kept(spark):
    kept = envelope.keep_secret(spark, "s3cret", "pass", 1000)
    assert "s3cret" not in kept and envelope.recall_secret(spark, kept, "pass", 1000) == "s3cret"
    with pytest.raises(ValueError):
        envelope.recall_secret(spark, kept, "other", 1000)


def test_hkdf_vector():
    """RFC 5869, test case 1."""
    okm = envelope.hkdf(bytes([0x0B] * 22), bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


@pytest.mark.parametrize("sql", ["select 1", "  SELECT * from range(3)", "with a as (select 1 as x) select * from a", "select 1 union all select 2", "select * from (values (1)) t(x) order by x limit 1"])
def test_gate_lets_queries_pass(spark, sql):
    assert gate.is_read_only(spark, sql)


@pytest.mark.parametrize(
    "sql",
    ["drop view x", "select 1; drop view x", "with a as (select 1) insert into t select * from a", "insert into t values (1)", "create table t as select 1", "values (1)", "from t select *", "set x = 1", "select (", "", None, "explain select 1", "cache table t"],
)
def test_gate_stops_the_rest(spark, sql):
    assert not gate.is_read_only(spark, sql)


def test_ids_agree_between_driver_sql_and_expressions(spark):
    from pyspark.sql import functions as F

    ids.register(spark)
    row = spark.range(1).select(ids.entity_id(F.lit("ns"), F.lit("Café")).alias("a"), F.expr("entity_id('ns', 'Café')").alias("b"), ids.claim_id(*map(F.lit, "spot")).alias("c"), F.expr("claim_id('s', 'p', 'o', 't')").alias("d")).first()
    assert row["a"] == row["b"] == ids.b32_id_of("e_", "ns", "Café") and row["c"] == row["d"] == ids.b32_id_of("c_", *"spot")
    assert len(row["a"]) == 26


def test_extension_versions_are_metadata():
    assert schema.extension_name("temporal@1") == ("temporal", 1) and schema.extension_name("coords") == ("coords", None)


@pytest.mark.parametrize(
    ("question", "kind", "topic"),
    [
        ("What contradicts what?", "contradictions", None), ("timeline of the merger?", "timeline", "the merger"), ("history of x", "timeline", "x"), ("show the chronology", "timeline", None), ("any outdated ones", "staleness", None),
        ("which were replaced", "lineage", None), ("new since march 2025", "changed_since", None), ("what did we decide about pricing?", "decisions_about", "pricing"), ("list decisions", "all_decisions", None), ("show all", "list_titles", None),
        ("anything regarding budgets.", "topic", "budgets"), ("find me all the invoices", "show_find", "invoices"), ("pricing strategy europe", "keyword", None), ("and so", "titles", None),
    ],
)
def test_questions_are_read(question, kind, topic):
    found = nlq.parse(question)
    assert (found.kind, found.topic) == (kind, topic)


def test_dates_in_questions():
    assert nlq.parse("since 2024-05-06").since == "2024-05-06"
    assert nlq.parse("after february 2023").since == "2023-02-01"
    assert nlq.parse("after june", default_year="2030").since == "2030-06-01"
    assert nlq.parse("tell pricing about strategy").kind == "topic" and nlq.parse("pricing strategy").words == ("pricing", "strategy")


def test_topics_are_never_sql(spark, shard):
    s = Session(spark)
    s.mount(shard)
    assert s.ask("find '; drop view claims; --").count() == 0 and s.ask("find 100%").count() == 0


def test_sentences(spark):
    text = "Dr. Smith came. He left!  Was it 3.5 mg? Été fini.\n\nNew part"
    got = chunk.sentences(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).collect()
    assert [r["text"] for r in got] == ["Dr. Smith came.", "He left!", "Was it 3.5 mg?", "Été fini.", "New part"]
    assert [r["index"] for r in got] == list(range(5))
    assert all(text.encode()[r["byte_start"] : r["byte_end"]].decode() == r["text"] for r in got)


def test_roles_and_merging(spark):
    parts = {
        "## Title": "HEADING", "> quoted\n> text": "VERBATIM", "Failure to comply brings sanctions.": "SANCTION", "A party must file within 30 days.": "DEADLINE",
        "The governing statute is clear.": "AUTHORITY", "See Smith v. Jones (1999).": "CASE", "Read § 2040 of it.": "SECTION", "Plain words here that go on for a while.": "PROSE", "More plain words, which belong to the same chunk.": "PROSE",
    }
    docs = spark.createDataFrame([(1, "\n\n".join(parts))], "doc_id long, text string")
    p = [r["text"] for r in chunk.paragraphs(docs).orderBy("idx").collect()]
    assert p == list(parts)
    from pyspark.sql import functions as F

    roles = {r["text"]: r["role"] for r in chunk.paragraphs(docs).withColumn("role", chunk.role(F.col("text"))).collect()}
    assert roles == parts
    chunks = chunk.legal_chunks(docs, least=0).collect()
    assert len(chunks) == len(parts) - 1 and chunks[-1]["chunk_type"].startswith("legal_")
    assert all("\n\n".join(parts).encode()[r["byte_start"] : r["byte_end"]].decode() == r["text"] for r in chunks)


def test_coordinates_count_up_by_entity(spark):
    at = derive.coordinate_names(derive.coords(spark.createDataFrame([("e3", "Paris"), ("e1", "London"), ("e2", "policy")], "entity_id string, label string")))
    got = {r["entity_id"]: (r["instance"], r["major_name"]) for r in at.collect()}
    assert got == {"e1": ("05-03-01-0001", "Location"), "e3": ("05-03-01-0002", "Location"), "e2": ("08-01-01-0001", "Abstract")}


def test_cursor(spark):
    p = spark.createDataFrame([(34,), (10,)], "last_sent_idx int")
    assert chunk.resume_cursor(p).first()["cursor"] == 30
    assert chunk.resume_cursor(p.where("last_sent_idx < 0")).first()["cursor"] == 0
    assert chunk.resume_cursor(spark.createDataFrame([(2,)], "last_sent_idx int")).first()["cursor"] == 0


def test_binding_joins_a_claims_text_once(spark):
    """What tells which claims stay, and where, holds no text of a claim; it does not go through a document's text."""
    from claimlake.operators import bind

    raw = spark.createDataFrame([("d", 0, "Acme said so.", "Acme", "says", "so much", [0], False), ("d", 0, "Acme said so.", "ACME", "says", "so much", [0], False), ("d", 1, "Acme said so.", "Acme", "says", "more", [0], False), ("d", 2, "x", "Acme", "says", "it", [9], False)], "doc_id string, pos int, claim_text string, subject string, predicate string, object string, sentence_ids array<int>, progress boolean")
    sentences = spark.createDataFrame([("d", 0, 0, 13, 0)], "doc_id string, index int, byte_start long, byte_end long, page int")
    docs = spark.createDataFrame([("d", "Acme said so.")], "doc_id string, text string")
    spans = bind.bound_spans(raw, sentences, docs)
    assert "claim_text" not in spans.columns and spans.count() == 1
    found = bind.bind(raw, sentences, docs).collect()
    assert [(r["doc_id"], r["pos"], r["subject"], r["object"], r["claim_text"], r["evidence"]) for r in found] == [("d", 0, "Acme", "so much", "Acme said so.", "Acme said so.")]


def test_votes_are_counted_in_one_shuffle(spark):
    from claimlake.operators import bind

    labels = spark.createDataFrame([(1, i, w) for i, w in enumerate(["a", "A", "A", "b", "B", " "])], "doc_id long, pos int, label string")
    votes = bind.canonical_forms(labels, spark.createDataFrame([], "doc_id long, acronym string, full_name string").limit(0))
    assert sorted(map(tuple, votes.collect())) == [(1, "a", "A"), (1, "b", "b")]
    assert votes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def test_few_strings_are_found_as_many_are():
    from claimlake.operators import beside

    text, needles = "aaa bab aaa", ["aa", "bab", "", None, "zz", "aa"]
    few = beside.found_in(text, needles)
    many = beside.found_in(text, [*needles, "q1", "q2", "q3", "q4"])
    assert few == tuple(x[: len(needles)] for x in many) == ([2, 1, 0, None, 0, 2], [2, 1, 0, None, 0, 2])


def test_locators_go_to_the_place_of_their_span(spark):
    """Repeated spans and locators, two spans of one place, and one without a locator."""
    from claimlake.operators import resolve

    claims = spark.createDataFrame([("c", "s", "p", "o", "literal:string", 0)], "claim_id string, subject string, predicate string, object string, object_type string, tier int")
    entities = spark.createDataFrame([("s", "S")], "entity_id string, label string")
    proof = spark.createDataFrame([("c", "h", 0, 1), ("c", "h", 5, 6)], "claim_id string, source_hash string, byte_start long, byte_end long")
    spans = spark.createDataFrame([("s1", "h", 0, 1, "a"), ("s1", "h", 0, 1, "a"), ("s2", "h", 0, 1, "b"), ("s3", "h", 5, 6, "c")], "span_id string, source_hash string, byte_start long, byte_end long, text string")
    locators = spark.createDataFrame([("s1", "text", 0, 7), ("s1", "text", 0, 7), ("s2", "page", 1, 8)], "span_id string, kind string, page_index int, paragraph_index int")
    chain = resolve.provenance_chain(claims, entities, proof, spans, locators)
    got = sorted((r["evidence"], r["kind"] or "", r["paragraph_index"] or -1) for r in chain.collect())
    assert got == [("a", "text", 7)] * 4 + [("b", "page", 8), ("c", "", -1)]
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan  # the chain's texts are not joined by span_id


def test_answers_are_not_joined_to_themselves(spark):
    from claimlake.operators import firewall

    answers = spark.createDataFrame([(1, "Its price is one [1]. Its weight is two of them [2].", [1]), (2, None, [1])], "answer_id int, answer string, valid_ids array<int>")
    checked = firewall.check(answers)
    assert "Join" not in checked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["answer_id"], r["pos"], r["status"]) for r in checked.collect()) == [(1, 0, "verified"), (1, 1, "fabricated")]


def test_a_chain_says_each_thing_once(spark):
    """Two claims and three sources that say one thing, an entity's label and a literal that read alike, and rows that differ in one part."""
    from claimlake.operators import resolve

    claims = spark.createDataFrame([("c1", "s", "p", "x", "literal", 0), ("c2", "s", "p", "e", "entity", 0), ("c3", "s", "p", "y", "literal", 1), ("c4", "s", "p", "long" * 20, "literal", 1)], "claim_id string, subject string, predicate string, object string, object_type string, tier int")
    entities = spark.createDataFrame([("s", "S"), ("e", "x")], "entity_id string, label string")
    proof = [("c1", "h1", 0, 1), ("c1", "h2", 0, 1), ("c2", "h3", 0, 1), ("c1", "h1", 2, 3), ("c3", "h1", 0, 1), ("c1", "h4", 0, 1), ("none", "h1", 0, 1), ("c4", "h1", 0, 1), ("c4", "h5", 0, 80), ("c4", "h2", 0, 1)]
    provenance = spark.createDataFrame(proof, "claim_id string, source_hash string, byte_start long, byte_end long")
    texts = [("h1", 0, 1, "x"), ("h2", 0, 1, "x"), ("h3", 0, 1, "x"), ("h4", 0, 1, "z"), ("h1", 2, 3, "x"), ("h5", 0, 80, "long" * 20)]
    spans = spark.createDataFrame(texts, "source_hash string, byte_start long, byte_end long, text string")
    want = resolve.provenance_chain(claims, entities, provenance, spans).select("subject", "predicate", "object", "byte_start", "byte_end", "evidence").distinct()
    once = resolve.said_once(claims, entities, provenance, spans)
    got = sorted(map(tuple, resolve.evidence_once(once, claims, entities, spans).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 6


def test_an_envelope_leaves_one_copy_of_its_shard(spark, tmp_path, monkeypatch):
    """What the query has sealed and opened is gone, no text is made distinct in a shuffle, and the setting is as it was."""
    from claimlake import runtime
    from claimlake.plans import stores

    made, before = [], spark.conf.get(runtime.TIDY)
    monkeypatch.setattr(stores, "scratch", lambda _: made.append(str(tmp_path / f"at{len(made)}")) or made[-1])
    df = stores.envelope_claims(spark, "/root/testdata/sf0.001")
    left = sorted(str(p.relative_to(at)).split("/", 2)[2] for at in made for p in Path(at).glob("*/*/**/*.parquet") if p.is_dir())
    assert left == ["evidence/spans.parquet", "graph/claims.parquet", "graph/entities.parquet"] and spark.conf.get(runtime.TIDY) == before
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate [entity_id", "")


def test_blobs_are_not_shuffled(spark, tmp_path):
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "a").write_bytes(b"blob")
    entries = spark.createDataFrame([("n", "a")], "name string, hash string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for blobs of any size
    try:
        plan = envelope._blobs(spark, str(tmp_path), entries)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    with pytest.raises(shards.ShardError):
        envelope._blobs(spark, str(tmp_path), spark.createDataFrame([("n", "b")], "name string, hash string"))


def test_an_envelope_that_consumes(spark, shard, tmp_path):
    """Sealed and opened table by table: the same files, and each goes when the next step has it."""
    whole, plain = str(tmp_path / "whole"), Path(shutil.copytree(shard, tmp_path / "plain"))
    kept = {f["path"]: f["plain_hash"] for f in envelope.seal(spark, shard, whole, b"secret", {"content/": "Red"})["files"]}
    head = envelope.seal(spark, str(plain), str(tmp_path / "sealed"), b"secret", {"content/": "Red"}, consume=True)
    assert {f["path"]: f["plain_hash"] for f in head["files"]} == kept and not [p for p in plain.rglob("*.parquet") if p.is_file()]
    blobs = tmp_path / "sealed" / "blobs"
    assert {p.name for p in blobs.iterdir()} == {f["blob"] for f in head["files"]}
    damaged = shutil.copytree(tmp_path / "sealed", tmp_path / "damaged")
    changed = next(damaged.joinpath("blobs").iterdir())
    changed.write_bytes(changed.read_bytes()[:-1] + b"x")
    with pytest.raises(shards.ShardError):
        envelope.open_envelope(spark, str(damaged), b"secret", str(tmp_path / "no"), consume=True)
    assert not [p for p in (tmp_path / "no").rglob("*") if p.is_file()]
    opened = envelope.open_envelope(spark, str(tmp_path / "sealed"), b"secret", str(tmp_path / "o"), consume=True)
    shards.verify(spark, opened, b"k")
    assert not list(blobs.iterdir())
