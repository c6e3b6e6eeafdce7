"""Mechanisms under the operators: evidence by automaton, greedy merge by rounds, paths by doubling, windows by jumps."""

import random

import pyarrow as pa
import pytest
from claimlake.operators import adaptive, beside, bind, closure, constraints, openers, prefix, validate
from claimlake.sources import chat, shards
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@given(st.text("abé ", max_size=40), st.lists(st.one_of(st.none(), st.text("abé ", max_size=4)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_automaton_counts_as_one_search_each(text, needles):
    apart, places = beside.found_in(text, needles)
    overlapping = [x and sum(text.startswith(x, i) for i in range(len(text))) for x in needles]
    assert apart == [None if x is None else text.count(x) if x else 0 for x in needles]
    assert places == [None if x is None else min(2, n) if x else 0 for x, n in zip(needles, overlapping, strict=True)]


def evidence_table(spark, n):
    docs = [(1, " ".join(f"w{i} w{i % 7}" for i in range(n))), (2, "été où été"), (3, None), (3, "twice here twice"), (None, "nobody's")]
    rows = [(1, k, f"w{k}") for k in range(n)] + [(1, n + k, "w3") for k in range(50)]
    rows += [(2, 0, "été"), (2, 1, "où"), (2, 2, ""), (2, 3, None), (2, 4, "absent"), (3, 0, "twice"), (9, 0, "unknown"), (None, 0, "x")]
    c = spark.createDataFrame([(d, k, e, "clash", 0, len((e or "").encode())) for d, k, e in rows], "doc_id long, pos int, evidence string, text string, byte_start long, byte_end long")
    return c, spark.createDataFrame(docs, "doc_id long, text string"), rows, docs


@pytest.mark.parametrize("part_bytes", [beside.PART_BYTES, 2000])
def test_a_document_with_many_candidates_is_dealt_out(spark, part_bytes):
    c, docs, rows, texts = evidence_table(spark, 400)
    result = [("n_found", "int", pa.int32()), ("n_places", "int", pa.int32())]
    got = beside.beside_text(c, docs, ["evidence"], result, beside.found_in, part_bytes)
    assert got.columns == [*c.columns, "n_found", "n_places"]
    want = []
    for d, k, e in rows:
        met = [t for i, t in texts if i == d and d is not None] or [None]
        want += [(d, k, e, None if t is None or e is None else t.count(e) if e else 0) for t in met]
    seen = sorted((tuple(r) for r in got.select("doc_id", "pos", "evidence", "n_found").collect()), key=str)
    assert seen == sorted(want, key=str)
    if part_bytes < 10_000:
        spread = beside.beside_text(c.where("doc_id = 1"), docs.where("doc_id = 1"), ["evidence"], [("part", "int", pa.int32())], lambda text, needles: ([len(needles)] * len(needles),), part_bytes)
        assert spread.agg(F.max("part")).first()[0] < 60 and spread.count() == 450


def test_evidence_of_empty_tables(spark):
    c, docs, _, _ = evidence_table(spark, 3)
    assert validate.evidence(c.limit(0), docs).collect() == [] and bind.unique_evidence(c, docs.limit(0)).collect() == []
    assert {r["ok"] for r in validate.evidence(c, docs.limit(0)).collect()} == {False}


def merged_by_scan(rows):
    out, keys, seen = [], set(), set()
    for o, s, e in sorted(rows):
        key = (s, e[:80])
        if key not in keys and e not in seen:
            keys.add(key), seen.add(e), out.append(o)
    return out


@pytest.mark.parametrize("last", [0, 5, bind.LAST])
def test_greedy_merge_is_the_scan(spark, last):
    draw = random.Random(last)
    head = "x" * 80
    rows = [(o, draw.choice("abc"), head + draw.choice("0123456789") if draw.random() < 0.7 else draw.choice(["short", "other", "a third"])) for o in range(300)]
    chain = [(o, "s", head + str(o // 2)) if o % 2 else (o, "s" if o % 4 else "t", head + str(o // 2)) for o in range(60)]
    for table in (rows, chain, []):
        df = spark.createDataFrame([(1, o, s, "p", "o", e) for o, s, e in table] + [(2, o, s, "p", "o", e) for o, s, e in table[:20]], "doc_id long, ordinal int, subject string, predicate string, object string, evidence string")
        got = bind.greedy_merge(df, last=last).select("doc_id", "ordinal").collect()
        assert sorted(r[1] for r in got if r[0] == 1) == merged_by_scan(table)
        assert sorted(r[1] for r in got if r[0] == 2) == merged_by_scan(table[:20])


def walk(start, step):
    seen = [start]
    while (x := step.get(seen[-1])) is not None and x not in seen:
        seen.append(x)
    return seen, x is not None


@given(st.dictionaries(st.integers(0, 30), st.integers(0, 35), max_size=31), st.randoms())
@settings(max_examples=12, deadline=None)
def test_paths_are_what_walking_gives(spark, step, draw):
    starts = [0, 1, 7, 33]
    few = draw.choice([0, closure.FEW_STEPS])
    df = closure.follow(spark.createDataFrame([(s,) for s in [*starts, None, 0]], "start long"), spark.createDataFrame([*step.items(), (None, 1), (40, None)], "node long, to long"), few)
    got = df.collect()
    for s in starts:
        path, again = walk(s, step)
        own = sorted((r["pos"], r["node"]) for r in got if r["start"] == s)
        assert own == list(enumerate(path)) and any(r["again"] for r in got if r["start"] == s) == again


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
@settings(max_examples=12, deadline=None)
def test_closure_has_the_least_depths(spark, edges):
    got = {(r["root"], r["cur"]): r["depth"] for r in closure.reach(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for root in range(13):
        level, depth, seen = {root}, 0, {root}
        while level:
            level, depth = {b for a, b in edges if a in level} - seen, depth + 1
            seen |= level
            want |= {(root, x): depth for x in level}
    assert got == want


def test_a_chain_of_ten_thousand_links(spark):
    n, rounds = 10_000, []
    claims = spark.range(n).selectExpr("concat('c', lpad(id, 6, '0')) as claim_id", "concat('a', id) as subject", "'DELEGATES_TO' as predicate", "concat('a', id + 1) as object", "'s' as shard_id")
    written, follow = closure.written, constraints.follow
    closure.written = lambda df, name: rounds.append(name) or written(df, name)
    constraints.follow = lambda a, b: follow(a, b, 0)
    try:
        chain = constraints.authority_chain(spark.createDataFrame([("a0",), ("a9990",)], "actor string"), claims).collect()
    finally:
        closure.written, constraints.follow = written, follow
    assert {r["actor"]: len(r["chain"]) for r in chain} == {"a0": n + 1, "a9990": 11} and not any(r["cycle"] for r in chain)
    assert {r["actor"]: r["chain"] for r in chain}["a9990"] == [f"a{i}" for i in range(9990, n + 1)]
    assert len(rounds) <= 16  # the table of single steps, fourteen rounds, and the one in which nothing grows


def test_a_conversation_of_many_turns(spark):
    nodes = spark.range(2000).selectExpr("'p' as path", "0 as conv", "concat('n', id) as node", "if(id = 0, null, concat('n', id - 1)) as parent", "double(id) as create_time")
    branch = spark.createDataFrame([("p", 0, "x", "n5", 1.0), ("p", 0, "y", "x", 9e9)], nodes.schema)
    for few in (0, closure.FEW_STEPS):
        follow, chat.follow = chat.follow, lambda a, b, few=few: closure.follow(a, b, few)
        try:
            got = chat.tree_path(nodes.unionByName(branch)).orderBy("pos").collect()
        finally:
            chat.follow = follow
        assert [r["node"] for r in got] == [f"n{i}" for i in range(2000)] and [r["pos"] for r in got] == list(range(2000))


def test_notes_name_the_revocations_of_the_chain(spark):
    claims = spark.createDataFrame(
        [("1", "a", "DELEGATES_TO", "b", "s"), ("2", "hq", "REVOKES", "B", "s"), ("3", "hq", "REVOKES", "z", "s"), ("4", "x", "PERMITS", "go", "s")], "claim_id string, subject string, predicate string, object string, shard_id string"
    )
    requests = spark.createDataFrame([("q", "a", "go", "t"), ("r", "Z", "go", "t")], "request_id string, actor string, action string, target string")
    got = {r["request_id"]: r for r in constraints.decide(requests, claims).collect()}
    assert got["q"]["notes"] == ["delegation_revoked:B"] and got["q"]["status"] == "permit" and got["q"]["chain"] == ["a", "b"]
    assert got["r"]["notes"] == ["delegation_revoked:z", "actor_authority_revoked:Z"] and got["r"]["status"] == "deny"
    every = {r["request_id"]: r["notes"] for r in constraints.decide(requests, claims, all_revocations=True).collect()}
    assert every["q"] == ["delegation_revoked:B", "delegation_revoked:z"]


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=40), st.sampled_from([1.0, 3.0, 10.0]), st.booleans(), st.sampled_from([0, 1000]))
@settings(max_examples=10, deadline=None)
def test_openers_are_what_a_scan_opens(spark, rows, span, strict, few):
    want, last = [], {}
    for key, t in sorted(set(rows)):
        if key not in last or (t / 4 > last[key][1] + span if strict else t / 4 >= last[key][1] + span):
            last[key] = (last[key][0] + 1 if key in last else 0, t / 4)
            want.append((key, *last[key]))
    points = spark.createDataFrame([(k, t / 4) for k, t in [*rows, *rows[:3]]] + [(None, 1.0), (1, None)], "key int, t double")
    follow = openers.follow
    openers.follow = lambda a, b: follow(a, b, few)
    try:
        assert sorted(tuple(r) for r in openers.openers(points, span, strict).collect()) == want
    finally:
        openers.follow = follow


def test_windows_of_a_rule_over_many_buckets(spark):
    draw = random.Random(3)
    times = sorted(draw.choice([draw.random() * 50, draw.random() * 4_000_000]) for _ in range(400))
    rows = [("r", t, 1.0) for t in times] + [("s", 5.0, 2.0), ("s", 5.0, 3.0)]
    got = sorted((r["rule_id"], r["ts"], r["window"]) for r in adaptive.windows_from_first(spark.createDataFrame(rows, "rule_id string, ts double, value double"), 7).collect())
    want, until, n = [], None, -1
    for t in times:
        if until is None or t > until:
            until, n = t + 7, n + 1
        want.append(("r", t, n))
    assert got == [*want, ("s", 5.0, 0), ("s", 5.0, 0)]
    sends = spark.createDataFrame([("b", 0.0), ("b", 0.0), ("b", 29.0), ("b", 30.0), ("c", 1.0)], "bundle_id string, ts double")
    allowed = sorted(tuple(r) for r in adaptive.allowed_sends(sends, 2).collect())
    assert allowed == [("b", 0.0, False), ("b", 0.0, True), ("b", 29.0, False), ("b", 30.0, True), ("c", 1.0, True)]


@pytest.mark.parametrize("ranges", [None, 7])
def test_running_sums_by_ranges(spark, ranges):
    draw = random.Random(8)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), i, draw.randrange(9)) for i in range(300)]
    got = {(r["k"], r["i"]): r["before"] for r in prefix.running(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), "v", ["i"], ("k",), ranges).collect()}
    assert got == {(k, i): sum(v for q, j, v in rows if q == k and j < i) for k, i, _ in rows}
    assert prefix.running(spark.createDataFrame([], "k string, i int, v int"), "v", ["i"], ("k",)).collect() == []


@pytest.mark.parametrize("suite", ["promote", "duplicate"])
def test_merkle_tree_is_the_root_of_all_leaves(spark, suite):
    for n in (0, 1, 2, 5, 8, 9, 33, 37):
        leaves = [f"leaf {i}" for i in range(n)]
        df = spark.createDataFrame(list(enumerate(leaves)), "i int, leaf string").repartition(3)
        for subtree in (4, 1024) if n < 9 else (4,):
            assert shards.merkle_tree(df, "i", "leaf", suite, subtree).first()[0] == shards.merkle_root([x.encode() for x in leaves], suite)
