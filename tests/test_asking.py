"""Calls that are kept: each prompt once, over failures, restarts and reads."""

import json
import os
import threading
import time
from collections import Counter

import pytest
from claimlake.operators import asking, bind
from pyspark.sql import functions as F


def model_of(folder, bad=()):
    """A model that notes each call in a file of its own, and fails for prompts of ``bad`` while the folder has no file ``well``."""
    folder = str(folder)
    os.makedirs(folder, exist_ok=True)

    def model(prompt):
        with open(f"{folder}/{time.time_ns()}-{threading.get_ident()}.call", "w") as f:
            f.write(prompt)
        if prompt in bad and not os.path.exists(f"{folder}/well"):
            raise TimeoutError("no answer")
        return f"re: {prompt}"

    return model, lambda: Counter(open(f"{folder}/{n}").read() for n in os.listdir(folder) if n.endswith(".call"))


def replies(df):
    return {r["prompt_key"]: r["reply"] for r in df.collect()}


def test_each_prompt_is_asked_once(spark, tmp_path):
    prompts = spark.range(300).select(F.when(F.col("id") == 299, None).otherwise(F.concat(F.lit("q"), F.col("id") % 120)).alias("prompt"))
    (model, calls), folder = model_of(tmp_path / "calls"), str(tmp_path / "kept")
    first = asking.ask(prompts, model, folder, every=5, parallel=3)
    assert first.count() == 120 and calls() == {f"q{i}": 1 for i in range(120)}
    again = asking.ask(prompts.unionByName(spark.createDataFrame([("new",)], "prompt string")), model, folder)
    assert again.count() == 121 and again.count() == 121 and calls() == {**{f"q{i}": 1 for i in range(120)}, "new": 1}
    assert set(replies(again).values()) == {f"re: {p}" for p in calls()}
    some = asking.ask(spark.createDataFrame([("q3",)], "prompt string"), model, folder)  # the answers of the prompts given, not all
    assert list(replies(some).values()) == ["re: q3"]
    assert asking.ask(prompts.limit(0), model, str(tmp_path / "none")).count() == 0
    assert not (tmp_path / "kept" / "pieces").exists()


def test_failures_are_asked_again_and_nothing_else(spark, tmp_path):
    prompts = spark.range(40).select(F.concat(F.lit("q"), "id").alias("prompt"))
    (model, calls), folder = model_of(tmp_path / "calls", {"q7", "q8"}), str(tmp_path / "kept")
    with pytest.raises(asking.Unanswered, match="2 prompts failed, the first with TimeoutError: no answer"):
        asking.ask(prompts, model, folder, tries=2)
    assert calls() == {f"q{i}": 2 if i in (7, 8) else 1 for i in range(40)}
    assert asking.answers(spark, folder).count() == 38
    (tmp_path / "calls" / "well").touch()
    assert asking.ask(prompts, model, folder).count() == 40
    assert calls() == {f"q{i}": 3 if i in (7, 8) else 1 for i in range(40)}


def test_pieces_of_a_run_that_was_cut_short_count(spark, tmp_path):
    """What a lost task has kept is neither asked again by its next attempt nor by the next run, and is one answer if it is in both."""
    prompts = spark.range(30).select(F.concat(F.lit("q"), "id").alias("prompt"))
    (model, calls), folder = model_of(tmp_path / "calls"), str(tmp_path / "kept")
    keys = {r["prompt"]: r["k"] for r in prompts.select("prompt", F.sha2("prompt", 256).alias("k")).collect()}
    system, root = asking.place(f"{folder}/pieces")
    for p in ("q1", "q2", "q2"):
        asking._keep(system, f"{root}/{keys[p][:asking.DIGITS]}", [(keys[p], f"re: {p}")])
    assert asking._kept(system, f"{root}/{keys['q1'][:asking.DIGITS]}") >= {keys["q1"]}
    found = asking.ask(prompts, model, folder)
    assert found.count() == 30 and calls() == {f"q{i}": 1 for i in range(30) if i not in (1, 2)}


def test_claims_by_kept_answers(spark, tmp_path):
    prompts = spark.createDataFrame([("d", 0, [1, 2], "a"), ("d", 3, [3], "b"), ("e", 0, [1], "a")], "doc_id string, batch_start int, ids array<int>, prompt string")
    said = lambda p: json.dumps({"claims": [{"claim_text": f"{p} holds", "sentence_ids": [1, 9]}]})
    plain, kept = bind.model_claims(prompts, said), bind.model_claims(prompts, said, str(tmp_path / "k"))
    key = lambda r: (r["doc_id"], r["batch_start"], r["claim_text"], r["sentence_ids"], r["ids_said"])
    assert sorted(map(key, kept.collect())) == sorted(map(key, plain.collect())) and kept.count() == 3


def test_strict_quotes(spark, tmp_path):
    body = "The valve opens at 40 bar. The valve opens at 40 bar. Nobody may close it by hand, é."
    chunks = [("d", 1, body, "text"), ("d", 2, body, "table"), ("d", 3, "short", "text"), ("e", 1, body + "!", None), ("f", 1, body + "?", "text"), ("g", 1, None, "text"), ("h", 1, body, "text")]
    df = spark.createDataFrame(chunks, "doc_id string, chunk_id long, text string, chunk_type string")

    def model(prompt):
        assert prompt.startswith("Find: ")
        if prompt.endswith("?"):
            return "no json"
        claims = [{"subject": " valve ", "quote": " The valve opens at 40 bar. ", "confidence": 0.9}, {"quote": "the valve"}, {"quote": ""}, {"subject": "x"}, {"quote": "hand, é", "predicate": "bars", "value": "2"}]
        return json.dumps({"claims": claims} if prompt.endswith("!") else claims)

    got = sorted(tuple(r) for r in asking.extracted(df, model, str(tmp_path / "k"), "Find: {content}").collect())
    at = body.index("hand, é")
    each = lambda d: [(d, 1, "unknown", "bars", "unknown", "2", 0.5, "hand, é", at, at + 7, 1), (d, 1, "valve", "related_to", "unknown", None, 0.9, "The valve opens at 40 bar.", 0, 26, 2)]
    assert got == [row for d in "deh" for row in each(d)]
