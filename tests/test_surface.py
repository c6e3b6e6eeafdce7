"""Registry, bundles, command line and server."""

import json
import threading
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from claimlake import __main__ as cli
from claimlake import bundles, registry
from claimlake.operators import emit
from claimlake.session import Session


def test_generators_run_in_order_and_names_are_taken_once(spark):
    docs = spark.createDataFrame([(1, "## NODE 1: Support\n\n> A quotation that is long enough to be kept.\n")], "doc_id long, text string")
    got = registry.run(docs, ["tier0_blockquotes", "tier0_headings"]).collect()
    assert {(r["generator"], r["pass"]) for r in got} == {("tier0_blockquotes", 0), ("tier0_headings", 1)}
    with pytest.raises(ValueError):
        registry.generator("tier0_headings")(lambda df: df)
    with pytest.raises(KeyError):
        registry.run(docs, ["none"])
    assert registry.plugins() == ({}, {})


def bundle(spark):
    t = lambda s, p, o: (s, p, o)
    return bundles.create(spark, {"bundle_id": "b1", "domain": "d", "scenario": "s", "tags": ["x"], "rules": [(t("a", "is", "b"), t("a", "does", "c"))], "baseline": 1.0, "improved": 1.2})


def test_bundles_are_complete_signed_and_found(spark, tmp_path):
    b = bundle(spark)
    assert b["entities"] == ["a", "b", "c"] and b["predicates"] == ["does", "is"] and len(b["topology_hash"]) == 64
    private, public = bundles.new_keys(spark)
    signed = bundles.sign(spark, b, private)
    assert bundles.is_signed(spark, signed, public) and not bundles.is_signed(spark, {**signed, "improved": 9.0}, public) and not bundles.is_signed(spark, b, public)
    rule = lambda r: {"condition": dict(zip(("subject", "predicate", "object"), r[0], strict=True)), "action": dict(zip(("subject", "predicate", "object"), r[1], strict=True))}
    bundles.save([{**signed, "rules": [rule(r) for r in signed["rules"]]}], str(tmp_path / "r.jsonl"))
    registry_ = bundles.load(spark, str(tmp_path / "r.jsonl"))
    assert bundles.by_status(registry_, "received").count() == 1
    targets = spark.createDataFrame([("t1", "d", "s", ["x"]), ("t2", "d", "z", ["q"]), ("t3", "z", "z", ["x"])], "target_id string, domain string, scenario string, tags array<string>")
    assert [r["target_id"] for r in bundles.matching(registry_, targets).collect()] == ["t1"]


def test_shadow_and_controller(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, v double")
    got = bundles.shadow(rows, lambda df: df, lambda df: df.withColumn("v", F.col("v") * 1.5), "k", "v").collect()
    assert [r["improvement"] for r in got] == [0.5, 0.5]
    c = bundles.Controller(spark)
    assert c.receive(bundle(spark), 0.9) == "testing" and c.receive({**bundle(spark), "bundle_id": "b2"}, 0.1) == "rejected"
    assert c.evaluate("b1") == "testing"
    for _ in range(60):
        c.record("b1", 0.2)
    assert c.evaluate("b1") == "human_review"
    c.approve("b1")
    assert c.bundles["b1"]["status"] == "adopted"
    with pytest.raises(ValueError):
        c.approve("b2")


def test_nary_claims_become_candidates(spark):
    claims = spark.createDataFrame([("p", [("subject", "a"), ("object", "b")], None, ["e"]), ("p", [("subject", "a")], "5", ["e"]), ("p", [], "5", ["e"]), ("p", [("subject", "a")], "5", [])], "predicate string, args array<struct<role string, entity_id string>>, value string, snippets array<string>")
    assert sorted((r["object"], r["object_type"]) for r in emit.from_args(claims).collect()) == [("5", "literal:string"), ("b", "entity")]


def test_confidence_report(spark):
    c = spark.createDataFrame([(0, 0.5, "p"), (None, None, "q"), (0, 1.0, "p")], "tier int, confidence double, predicate string")
    report = emit.confidence_report(c)
    assert report["tiers"]["0"] == {"n": 2, "mean": 0.75, "least": 0.5, "most": 1.0} and report["tiers"]["3"]["mean"] == 0.7 and report["predicates"] == {"p": 2, "q": 1}


def test_server_answers(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), cli.handler(Session(spark), "t"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None, token="t"):
        request = urllib.request.Request(base + path, data=None if body is None else json.dumps(body).encode(), headers={"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    assert call("/health")[1]["status"] == "ok" and call("/catalog") == (200, [])
    assert call("/query", {"sql": "select 1 as x"})[1] == {"columns": ["x"], "rows": [[1]]}
    assert call("/query", {"sql": "drop view claims"})[0] == 400 and call("/none")[0] == 404 and call("/health", token="x")[0] == 401
    assert call("/chat", {"question": "find x"})[1]["rows"] == []
    server.shutdown()


def test_shell_shows_and_goes_on(spark, capsys):
    cli.shell(Session(spark), ["select 7 as seven", "drop view claims", "", "quit", "select 8"])
    out = capsys.readouterr().out
    assert "seven" in out and "NotReadOnly" in out and "8" not in out


def envelope_of(spark, folder, files, version, secret, tamper=None):
    """An envelope as other writers make them: one key, a nonce for each file."""
    import base64
    import hashlib

    from claimlake.sources.envelope import hkdf
    from pyspark.sql import functions as F

    b64 = lambda b: base64.b64encode(b).decode()
    dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    salt, entries = b"s" * 16, []
    key = hkdf(secret, salt, b"files")
    (folder / "blobs").mkdir(parents=True)
    for i, (name, data) in enumerate(files.items()):
        nonce, plain = bytes([i]) * 12, hashlib.sha256(data).hexdigest()
        aad = dump({"envelope_id": "e1", "shard_id": "s1", "path": name, "plaintext_hash": plain}).encode()
        whole = spark.range(1).select(F.aes_encrypt(F.lit(data), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(nonce), F.lit(aad)).alias("c")).first()["c"]
        blob = bytes(whole)[12:]
        digest = hashlib.sha256(blob).hexdigest()
        (folder / "blobs" / digest).write_bytes(blob if tamper != "blob" else blob[:-1] + b"x")
        entries.append({"path": name, "blob_hash": digest, "nonce_b64": b64(nonce), **({"plaintext_hash": plain} if version == "1.1" else {})})
    head = {"format_version": version, "envelope_id": "e1", "shard_id": "s1", "encryption_algo": "AES-256-GCM", "kdf": {"name": "HKDF-SHA256", "salt_b64": b64(salt), "info": "files"}, "files": entries}
    digest = hashlib.sha256(dump(sorted(entries, key=lambda e: e["path"].encode())).encode()).digest()
    head["files_digest_sha256_b64"] = b64(digest if tamper != "digest" else b"0" * 32)
    if tamper == "path":
        head["files"] = [{**e, "path": "../" + e["path"]} for e in entries]
        head.pop("files_digest_sha256_b64")
    (folder / "envelope.json").write_text(json.dumps(head))
    return str(folder)


def test_envelopes_of_the_first_versions(spark, tmp_path):
    from pathlib import Path

    from claimlake.sources.envelope import open_envelope
    from claimlake.sources.shards import ShardError

    files = {"manifest.json": b"{}", "graph/é.bin": bytes(range(256))}
    secret = b"k" * 32
    opened = Path(open_envelope(spark, envelope_of(spark, tmp_path / "a", files, "1.1", secret), secret, str(tmp_path / "out")))
    assert {str(p.relative_to(opened)): p.read_bytes() for p in opened.rglob("*") if p.is_file()} == files
    for name, version, tamper, other in (("b", "1.1", "blob", secret), ("c", "1.1", "digest", secret), ("d", "1.1", "path", secret), ("e", "1.1", None, b"w" * 32), ("f", "9.9", None, secret)):
        into = tmp_path / f"out_{name}"
        with pytest.raises(ShardError):
            open_envelope(spark, envelope_of(spark, tmp_path / name, files, version, secret, tamper), other, str(into))
        assert not [p for p in into.rglob("*") if p.is_file()]
    # 1.0 binds a blob's own hash, which no writer knows before the blob is made: the entry is read, its tag cannot fit
    with pytest.raises(ShardError, match="changed"):
        open_envelope(spark, envelope_of(spark, tmp_path / "g", files, "1.0", secret), secret, str(tmp_path / "out_g"))


def test_index_and_search(spark, tmp_path):
    from claimlake.sources import shards

    docs = spark.createDataFrame([(1, "Aspirin lowers fever. Rome is a city.")], "doc_id long, text string")
    said = spark.createDataFrame([(1, "Aspirin", "lowers", "fever", "literal:string", "Aspirin lowers fever.", 0, 21, 0), (1, "Rome", "is", "city", "literal:string", "Rome is a city.", 22, 37, 0)], "doc_id long, subject string, predicate string, object string, object_type string, evidence string, byte_start long, byte_end long, tier int")
    shards.compile_shard(said, docs, str(tmp_path / "shard"))
    s = Session.from_environment(spark, {"CLAIMLAKE_AUDIT": str(tmp_path / "audit"), "CLAIMLAKE_VERIFY": "0"})
    assert not s.verify and s.audit == str(tmp_path / "audit")
    with pytest.raises(ValueError):
        s.search("fever")
    s.mount(str(tmp_path / "shard"))
    assert s.index() == {"status": "ok", "indexed": 2, "index_size": 2} and s.index() == {"status": "ok", "indexed": 0, "index_size": 2}
    assert [r["text"] for r in s.search("what lowers fever", 1).collect()] == ["Aspirin lowers fever"]
    assert s.index(lambda texts: [[1.0, float("Rome" in t)] for t in texts])["indexed"] == 2
    assert s.search("Rome", 1).first()["text"] == "Rome is city"
    assert s.query_json("select * from claims order by claim_id", most=1)["truncated"]
    (tmp_path / "red.jsonl").write_text('{"claim_id": "c9"}\n')
    assert s.colour_views(str(tmp_path)) == ["claims_red"] and spark.table("claims_red").first()["claim_id"] == "c9"


def test_pack_differences(spark, tmp_path):
    from claimlake.operators import graph

    for name, lines in (("a", ['{"id": "x", "v": 1, "w": 2}', '{"id": "y"}', "", '{"v": 3}', '{"id": "z", "v": 1}']), ("b", ['{"w": 2, "id": "x", "v": 1}', '{"id": "z", "v": 2}', '{"id": "n"}'])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "concepts.jsonl").write_text("\n".join(lines) + "\n")
    assert sorted(map(tuple, graph.diff_packs(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect())) == [("concepts", "n", "added"), ("concepts", "y", "removed"), ("concepts", "z", "modified")]


def test_forms_of_hashes(spark):
    import hashlib

    from claimlake.operators import graph
    from claimlake.sources.shards import merkle_root

    h = lambda *parts: hashlib.sha256(b"".join(parts)).digest()
    assert merkle_root([b"a", b"b", b"c"], "duplicate") == h(h(h(b"a"), h(b"b")), h(h(b"c"), h(b"c"))).hex()
    assert merkle_root([b"a", b"b", b"c"]) != merkle_root([b"a", b"b", b"c"], "duplicate")
    edges = [spark.createDataFrame(rows, "subject string, predicate string, object string") for rows in ([("a|b", "c", "d")], [("a", "b|c", "d")])]
    assert len({graph.topology_hash(e, "delimited").first()[0] for e in edges}) == 1 and len({graph.topology_hash(e).first()[0] for e in edges}) == 2


def test_long_chains_have_no_level_limit(spark):
    from claimlake.operators import constraints, graph

    lineage = spark.createDataFrame([(f"s{i}", f"s{i - 1}") for i in range(1, 151)], "shard_id string, supersedes_shard_id string")
    assert graph.lineage_closure(lineage).where("root = 's150'").count() == 150
    claims = spark.createDataFrame([(f"c{i}", f"a{i}", "DELEGATES_TO", f"a{i + 1}", "s") for i in range(130)], "claim_id string, subject string, predicate string, object string, shard_id string")
    chain = constraints.authority_chain(spark.createDataFrame([("q", "a0")], "request_id string, actor string"), claims).first()
    assert len(chain["chain"]) == 131 and not chain["cycle"]


def test_model_counters(spark):
    from claimlake.operators import bind

    prompts = spark.createDataFrame([(1, 0, [0, 1], "p"), (1, 2, [2, 3], "q"), (1, 4, [4], "r")], "doc_id long, batch_start int, ids array<int>, prompt string")
    reply = {"p": '{"claims": [{"claim_text": "x", "sentence_ids": [0, 7]}, {"claim_text": "y", "sentence_ids": [9]}, {"claim_text": " ", "sentence_ids": [1]}]}', "q": '{"claims": [{"claim_text": "z", "sentence_ids": [2]}]}', "r": "none"}
    said = bind.model_claims(prompts, lambda prompt: reply[prompt])
    assert tuple(bind.ask_report(said).first()) == (3, 2, 2, 1)
