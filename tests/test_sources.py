"""Formats, chats, logs, streams and the validators."""

import io
import json
import zipfile

import pytest
from claimlake.operators import adaptive, bind, firewall, validate
from claimlake.sources import chat, documents, formats
from claimlake.streaming import logs
from pyspark.sql import functions as F


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="w" xmlns:a="a"'
FILES = {
    "a.txt": "plain é".encode(),
    "b.md": b"# Title",
    "c.html": b"<html><script>no</script><nav>no</nav><h1>Head</h1><p>One <b>two</b></p><li>Item</li></html>",
    "d.html": b"<div>only   text</div>",
    "e.docx": zipped({"word/document.xml": f"<w:document {W}><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:p><w:t>Third</w:t></w:p></w:document>"}),
    "f.pptx": zipped({"ppt/slides/slide2.xml": f"<sld {W}><a:p><a:t>Two</a:t></a:p></sld>", "ppt/slides/slide1.xml": f"<sld {W}><a:p><a:t>One</a:t></a:p></sld>"}),
    "g.xlsx": zipped(
        {
            "xl/workbook.xml": '<workbook><sheet name="People"/></workbook>',
            "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><t>Age</t></si><si><t>Ann</t></si></sst>",
            "xl/worksheets/sheet1.xml": '<s><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c></row></s>',
        }
    ),
    "h.csv": b"name,city\nAnn,Rome\n,Oslo\n\n",
    "i.tsv": b"name\tcity\nAnn\tRome\n",
    "j.json": b'{"a":1}',
    "k.xml": b"<a>x <b>y</b></a>",
    "l.xbrl": b'<x><EntityRegistrantName contextRef="c">Acme</EntityRegistrantName><NetIncome contextRef="c" unitRef="USD">5</NetIncome><context>c</context></x>',
    "m.ics": b"BEGIN:VEVENT\r\nSUMMARY:Meet\r\nDTSTART;TZID=X:20240101\r\nLOCATION:Room\r\n 1\r\nEND:VEVENT",
    "n.rss": b"<rss><item><title>News</title><pubDate>Mon</pubDate><description>d</description></item></rss>",
    "o.atom": b'<feed><entry><title>Post</title><link href="http://x"/></entry></feed>',
    "p.pdf": b"%PDF",
    "q.exe": b"MZ",
    "r.docx": b"broken",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (path / name).write_bytes(data)
    return str(path)


def test_every_format(spark, folder):
    found = documents.files(spark, folder)
    got = {}
    for r in documents.blocks(found).orderBy("path", "block_idx").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["text"], r["locator"], r["error"]))
    texts = {k: [t for t, _, _ in v] for k, v in got.items()}
    assert texts["a.txt"] == ["plain é"] and texts["c.html"] == ["Head", "One two", "Item"] and texts["d.html"] == ["only text"]
    assert [x[1]["tag"] for x in got["c.html"]] == ["h1", "p", "li"]
    assert texts["e.docx"] == ["First", "Third"] and got["e.docx"][1][1]["paragraph_index"] == "2"
    assert texts["f.pptx"] == ["One", "Two"] and texts["k.xml"] == ["x y"] and got["g.xlsx"][0][1]["sheet_name"] == "People"
    for name in ("p.pdf", "q.exe", "r.docx"):
        assert got[name][0][2]
    lifted = {(r["path"].rsplit("/", 1)[1], r["subject"], r["predicate"], r["object"]) for r in documents.lifted(found).collect()}
    assert {("g.xlsx", "Ann", "Age", "7"), ("h.csv", "Ann", "city", "Rome"), ("h.csv", "record_1", "city", "Oslo"), ("i.tsv", "Ann", "city", "Rome")} <= lifted
    assert {("l.xbrl", "Acme", "net_income", "5 USD"), ("m.ics", "Meet", "scheduled_at", "20240101"), ("m.ics", "Meet", "located_at", "Room1"), ("n.rss", "News", "published_at", "Mon"), ("o.atom", "Post", "published_at", "http://x")} <= lifted


def test_unsupported_and_registry():
    with pytest.raises(ValueError):
        formats.parse("x.unknown", b"")
    assert len(formats.PARSERS) >= 20


def test_ingest_and_plan(spark, folder):
    found = documents.files(spark, folder, (".txt", ".md"))
    assert {r["file_name"] for r in documents.ingest(found).collect()} == {"a.txt", "b.md"}
    plan = documents.plan_job(found).first()
    assert (plan["n_files"], plan["n_lines"], plan["n_chunks"], plan["seconds"]) == (2, 2, 1, 9.0)


def test_normalise(spark):
    df = spark.createDataFrame([("é\r\nx\ry",), ("a\r\n",), (None,)], "t string")
    assert [r[0] for r in df.select(documents.normalise(df["t"])).collect()] == ["é\nx\ny", "a\n", None]


def test_chats(spark):
    claude = json.dumps([{"uuid": "u", "name": "Talk", "created_at": "2024-01-01T00:00:00.000000+00:00", "chat_messages": [{"uuid": "m", "sender": "human", "text": "Hi", "created_at": "2024-01-01T00:00:01+00:00"}, {"uuid": "n", "sender": "assistant", "text": " ", "created_at": ""}]}])
    node = lambda i, parent, t, role, text: {"id": i, "parent": parent, "message": {"id": i, "author": {"role": role}, "create_time": t, "content": {"parts": [text]}}}
    tree = json.dumps([{"id": "t", "title": "Tree", "create_time": 0, "mapping": {"r": {"id": "r", "parent": None, "message": None}, "a": node("a", "r", 1.0, "user", "Q"), "b": node("b", "a", 2.0, "assistant", "old"), "c": node("c", "a", 3.0, "assistant", "new")}}])
    flat = json.dumps([{"title": "Flat", "messages": [{"role": "user", "content": "Yo"}]}])
    generic = json.dumps([{"role": "user", "content": "Hey"}, {"role": "bot", "text": "Ho"}])
    docs = spark.createDataFrame([("1", claude), ("2", tree), ("3", flat), ("4", generic), ("5", '{"x": 1}')], "path string, text string")
    kinds = {r["path"]: r["k"] for r in docs.select("path", chat.detect(docs["text"]).alias("k")).collect()}
    assert kinds == {"1": "chat_claude", "2": "chat_openai", "3": "chat_openai", "4": "chat_generic", "5": "json"}
    turns = chat.turns(docs)
    got = {}
    for r in turns.orderBy("path", "pos").collect():
        got.setdefault(r["path"], []).append((r["role"], r["text"], r["ts"]))
    assert got["1"] == [("human", "Hi", "2024-01-01T00:00:01Z")]
    assert [t for _, t, _ in got["2"]] == ["Q", "new"] and got["2"][0][2] == "1970-01-01T00:00:01Z"
    assert got["3"] == [("user", "Yo", None)] and [t for _, t, _ in got["4"]] == ["Hey", "Ho"]
    blocks = chat.blocks(turns.withColumnRenamed("path", "conv_id").withColumnRenamed("pos", "turn")).collect()
    assert "HUMAN [2024-01-01T00:00:01Z]:\nHi" in {r["block"] for r in blocks}


def test_missing_logs_are_empty(spark, tmp_path):
    assert documents.read_log(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    documents.append_line(str(tmp_path / "x.jsonl"), {"a": 1})
    documents.append_line(str(tmp_path / "x.jsonl"), {"a": 2})
    assert documents.read_log(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2


def run(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_streams(spark, tmp_path):
    seqs = str(tmp_path / "seq")
    spark.createDataFrame([("s", i) for i in (1, 2, 4)], "stream_id string, seq long").write.parquet(seqs)
    gaps = run(logs.sequence_gaps(logs.read_stream(spark, seqs, "stream_id string, seq long", "parquet")), "g", spark)
    assert [(r["previous"], r["seq"]) for r in gaps] == [(2, 4)]


def test_event_stream_windows_and_sink(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "ev").mkdir()

    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "ev" / "p"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev" / "p")).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = run(logs.windowed_counts(stream, "ts", "event_type", "value"), "c", spark)
    assert counts
    q = logs.append(logs.deduplicated(stream, "ts", ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_validators(spark):
    spans = spark.createDataFrame([("h", "-1", "2"), ("h", "3", "2"), ("h", "0", "99"), ("x", "0", "1"), ("h", "a", "1"), ("h", "0", "5")], "source_hash string, byte_start string, byte_end string")
    got = sorted(r["reason"] for r in validate.span_bounds(spans, spark.createDataFrame([("h", 5)], "source_hash string, size long")).collect())
    assert got == ["beyond_source", "invalid_range", "invalid_range", "not_an_integer", "unknown_source"]
    docs = spark.createDataFrame([(1, "aé aé b")], "doc_id long, text string")
    c = spark.createDataFrame([(1, "aé", 0, 3), (1, "b", 8, 9), (1, "b", 7, 8), (1, "", 0, 0), (1, "b", 8, 99)], "doc_id long, evidence string, byte_start long, byte_end long")
    checked = validate.evidence(c, docs)
    assert [r["ok"] for r in checked.orderBy("evidence", "byte_start", "byte_end").collect()] == [False, True, False, True, False]
    report = validate.evidence_report(checked).first()
    assert (report["validated"], report["dropped"], report["ambiguous"], report["drop_rate"]) == (5, 3, 1, 0.6)
    seq = spark.createDataFrame([("s", 1), ("s", 2), ("s", 4), ("t", 9)], "stream_id string, seq long")
    assert [(r["previous"], r["seq"]) for r in validate.stream_gaps(seq).collect()] == [(2, 4)]
    claims = spark.createDataFrame([("c", "p", [("subject", "e")], ["x"]), ("d", "", [("subject", "e")], ["x"]), ("e", "p", [("object", "e")], ["x"]), ("f", "p", [("subject", "e")], [])], "claim_id string, predicate string, args array<struct<role string, entity_id string>>, source_spans array<string>")
    assert {r["claim_id"]: r["reason"] for r in validate.claim_rows(claims).collect()} == {"d": "no_predicate", "e": "no_subject", "f": "no_span"}


def test_replies_are_read():
    assert bind.parse_reply('sure: {"claims": []} done') == {"claims": []}
    assert bind.parse_reply('see {"a": 1} there') is None and bind.parse_reply("no") is None and bind.parse_reply('{"a": 1}') == {"a": 1}


def stand_in(prompt):
    return json.dumps({"claims": [{"claim_text": f"about {prompt}", "sentence_ids": [0, 9]}, {"claim_text": " ", "sentence_ids": [0]}, "x", {"claim_text": "y", "sentence_ids": [77]}]})


def test_model_claims_keep_to_their_batch(spark):
    reply = stand_in("p")
    prompts = spark.createDataFrame([(1, 0, [0, 1], "p")], "doc_id long, batch_start int, ids array<int>, prompt string")
    assert [(r["claim_text"], r["sentence_ids"]) for r in bind.ask_model(prompts, lambda prompt: reply).collect()] == [("about p", [0])]


def test_citations_resolve(spark):
    answers = spark.createDataFrame([(1, "This is a fact of some length [1, 2].", [1])], "answer_id int, answer string, valid_ids array<int>")
    context = spark.createDataFrame([(1, "c1")], "cite int, claim_id string")
    got = firewall.resolve_citations(firewall.check(answers), context).orderBy("cite").collect()
    assert [(r["cite"], r["fabricated"]) for r in got] == [(1, False), (2, True)]


def test_adaptive_rules(spark):

    w = spark.createDataFrame([("up", i, 1.2) for i in range(3)] + [("down", i, 0.9) for i in range(3)] + [("new", 0, 9.0)], "rule_id string, window long, value double")
    assert {r["rule_id"]: r["recommendation"] for r in adaptive.judge(w, F.lit(1.0)).collect()} == {"up": "promote", "down": "demote", "new": "maintain"}
    sends = spark.createDataFrame([("b", t) for t in (0.0, 10.0, 30.0, 61.0)], "bundle_id string, ts double")
    assert [r["allowed"] for r in adaptive.allowed_sends(sends, 2).orderBy("ts").collect()] == [True, False, True, True]
    assert adaptive.latest(w, "rule_id", "window", 1).count() == 3
    assert [adaptive.next_state(*x) for x in (("received", 0, "adopt", 0), ("received", 0, "reject", 0), ("received", 0, "adopt", 5), ("testing", 10, "adopt", 1), ("testing", 60, "adopt", 1), ("testing", 60, "reject", 1))] == ["testing", "rejected", "queued", "testing", "human_review", "rejected"]


def test_windows_over_batches_with_a_restart_late_rows_and_timers(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "rule_id string, ts double, value double"

    def arrive(*rows):
        spark.createDataFrame([(r, 1000.0 + t, 1.0) for r, t in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = logs.read_stream(spark, source, schema, "parquet")
        table = logs.run_once(logs.rule_windows(stream, 300, "100 seconds"), str(tmp_path / "run"))  # each call starts the query anew
        return sorted((r["rule_id"], r["window"], r["start"] - 1000, r["n"]) for r in table.collect())

    assert arrive(("a", 100), ("a", 0), ("b", 50)) == []
    # The record at 40 comes a batch later and in its place; the watermark (at 500) closes both rules' first windows by timer.
    assert arrive(("a", 40), ("a", 301), ("a", 400), ("c", 600)) == [("a", 0, 0.0, 3), ("b", 0, 50.0, 1)]
    # A record behind the watermark is dropped.
    assert arrive(("a", 10), ("a", 550), ("a", 700), ("c", 1000)) == [("a", 0, 0.0, 3), ("a", 1, 301.0, 3), ("b", 0, 50.0, 1)]


def test_records_behind_the_watermark_do_not_wait_for_the_latest_one(spark, tmp_path):
    """The latest record is a fraction of a millisecond ahead of the watermark, those before it are behind."""
    source, schema = str(tmp_path / "in"), "rule_id string, ts double, value double"
    for rows in ([0.0001, 50.0002], [50.0004, 400.0005, 1000.00025]):
        spark.createDataFrame([("a", 1000 + t, 1.0) for t in rows], schema).coalesce(1).write.mode("append").parquet(source)
        table = logs.run_once(logs.rule_windows(logs.read_stream(spark, source, schema, "parquet"), 300, "0 seconds"), str(tmp_path / "run"))
    assert sorted((r["window"], r["n"]) for r in table.collect()) == [(0, 3), (1, 1)]


def test_a_chain_is_checked_across_batches(spark, tmp_path):
    import hashlib

    source, schema = str(tmp_path / "in"), "stream_id string, seq long, hash string, prev_hash string, payload string"
    rows, before = [], ""
    for seq in range(6):
        own = hashlib.sha256(f"{before}\x1fp{seq}".encode()).hexdigest()
        rows.append(("s", seq, own, before, f"p{seq}"))
        before = own
    rows[3] = (*rows[3][:4], "changed")
    rows[5] = (*rows[5][:3], "other", rows[5][4])
    for part in (rows[:2], rows[2:4], [rows[5]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        table = logs.run_once(logs.broken_chain(logs.read_stream(spark, source, schema, "parquet")), str(tmp_path / "run"))
    assert sorted((r["seq"], r["reason"]) for r in table.collect()) == [(3, "hash"), (5, "gap"), (5, "hash")]


def test_whole_files_are_put_as_a_whole_or_not_at_all(spark, tmp_path):
    from claimlake.sources.whole_files import write_files

    rows = spark.range(300).select(F.format_string("d%d/é %d.bin", F.col("id") % 7, "id").alias("path"), F.concat(F.lit("body "), "id").cast("binary").alias("content"), F.concat(F.lit("n"), "id").alias("note")).repartition(5)
    target, notes = tmp_path / "deep" / "files", tmp_path / "notes"
    write_files(rows, str(target), str(notes))
    read = lambda: {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file()}
    assert read() == {f"d{i % 7}/é {i}.bin": f"body {i}".encode() for i in range(300)}
    assert sorted(json.loads(x) for x in notes.read_text().splitlines()) == sorted(f"n{i}" for i in range(300))
    before = read()
    for bad in ("../out", "/abs", "a/../../b", None):  # an unsafe path, then no content: nothing changes, nothing is left beside it
        write_files(rows.withColumn("path", F.when(F.col("note") == "n7", F.lit(bad)).otherwise(F.col("path"))), str(target))
        assert read() == before and [p.name for p in target.parent.iterdir()] == ["files"]
    write_files(rows.withColumn("content", F.when(F.col("note") != "n9", F.col("content"))), "file:" + str(target))
    assert read() == before and [p.name for p in target.parent.iterdir()] == ["files"]
    write_files(rows.where("note = 'n9'"), "file:" + str(target))  # replaces all
    assert list(read()) == ["d2/é 9.bin"]
    write_files(rows.where("note = 'none'"), str(target))
    assert read() == {} and target.is_dir()


def test_a_file_task_that_runs_twice_or_fails_leaves_the_same(tmp_path):
    from claimlake.sources.whole_files import FilesWriter

    rows = [{"path": f"a/{i}", "content": bytes([i]) * 10, "note": str(i)} for i in range(4)]

    def failing():
        yield from rows[:2]
        raise RuntimeError("lost")

    writer = FilesWriter(str(tmp_path / "t"), None)
    with pytest.raises(RuntimeError):
        writer.write(failing())
    first = writer.write(iter(rows))
    again = writer.write(iter(rows))
    writer.commit([first if len(first.notes) > len(again.notes) else again, None])
    assert {p.name: p.read_bytes() for p in (tmp_path / "t" / "a").iterdir()} == {str(i): bytes([i]) * 10 for i in range(4)}
    other = FilesWriter(str(tmp_path / "u"), None)
    other.abort([other.write(iter(rows))])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_seconds_keep_their_fraction(spark, tmp_path):
    """Events of one user within a second of a limit, of a day's end and of a bound; the SQL of the queries says what is right."""
    import duckdb
    from claimlake.plans import catalog

    at = "2024-01-05 23:59:59.7", "2024-01-06 00:00:00.2", "2024-01-06 01:39:59.8", "2024-01-07 00:00:00.1", "2024-01-10 23:59:59.9", "2024-01-20 00:00:00.4", "2024-01-21 00:00:00.3", "2024-01-25 00:00:00.0"
    events = spark.createDataFrame([(2 * i, t, 7) for i, t in enumerate(at)], "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("rate_limit", "rule_windows", "rule_judgement", "instants"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r) for r in con.sql(f"select {', '.join(df.columns).replace('window', '"window"')} from ({catalog.ORACLES[name]})").fetchall()), name


def test_a_mean_on_the_threshold_is_not_below_it(spark):
    """0.06 and 0.14 and so on: their doubles add up to less or more, as they are ordered."""
    bundles = spark.createDataFrame([("b", 0.9, 1.0, 1.1)], "bundle_id string, context_score double, baseline double, improved double")
    values = [0.01, 0.19, 0.02, 0.18, 0.03, 0.17, 0.04, 0.16, 0.07, 0.13, 0.06, 0.14]
    for order in (values, values[::-1], sorted(values), sorted(values, reverse=True), values[::2] + values[1::2]):
        shadows = spark.createDataFrame([("b", v) for v in order], "bundle_id string, improvement double").coalesce(1)
        assert [tuple(r) for r in adaptive.evaluate(bundles, shadows).select("improvement", "recommendation").collect()] == [(0.1, "adopt")]
    odd = spark.createDataFrame([("b", v) for v in (1e30, 0.5)], "bundle_id string, improvement double")
    assert adaptive.evaluate(bundles, odd).first()["improvement"] == 5e29


def test_a_mean_goes_by_the_rows_in_turn_where_the_sql_does(spark, tmp_path):
    """Means of just the threshold, in one file: the SQL's answer is that of its rows in turn, whatever the threads."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq
    from claimlake.plans import catalog

    values = [1, 19, 2, 18, 3, 17, 4, 16, 7, 13, 6, 14]
    orders = [values, values[::-1], sorted(values), sorted(values, reverse=True), values[::2] + values[1::2], sorted(values, key=lambda v: v * 7 % 11)]
    rows = [(1000 - 20 * user + v, 10 * user + 9) for user, order in enumerate(orders) for v in order]  # ids do not ascend
    pq.write_table(pa.table({"event_id": [r[0] for r in rows], "user_id": [r[1] for r in rows]}), f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = catalog.bundle_evaluation(spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.sql(f"select {', '.join(df.columns)} from ({catalog.ORACLES['bundle_evaluation']})").fetchall())
    assert {r[df.columns.index("recommendation")] for r in got} == {"reject", "adopt"}
