"""Joins that find what is alike or contained, held to all pairs, with hot keys on both sides."""

import random
from collections import Counter

import pytest
from claimlake.operators import adaptive, constraints
from claimlake.operators.blocks import block_join
from pyspark.sql import functions as F


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_block_join_is_the_join(spark):
    left = spark.range(400).select(F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"), F.col("id").alias("b"))
    wanted = rows_of(left.join(right, "k").select("k", "a", "b"))
    for block in (7, 50, 10_000):
        assert rows_of(block_join(left, right, ["k"], block).select("k", "a", "b")) == wanted
    shares = block_join(left, right, ["k"], 50).groupBy(F.spark_partition_id()).count()
    assert shares.agg(F.sum("count")).first()[0] == sum(wanted.values())
    assert block_join(left.limit(0), right, ["k"], 5).count() == 0
    twice = left.unionByName(left)  # repeated rows stay repeated
    assert rows_of(block_join(twice, right, ["k"], 50).select("k", "a", "b")) == rows_of(twice.join(right, "k").select("k", "a", "b"))


def contexts(spark, n, name, seed):
    r = random.Random(seed)
    tags = [None, "", *[f"t{i}" for i in range(12)]]
    data = []
    for i in range(n):
        own = None if r.random() < 0.05 else [r.choice(tags[: r.choice((4, 14))]) for _ in range(r.choice((0, 1, 2, 3, 3, 5)))]
        data.append((i, None if r.random() < 0.05 else r.choice("ddddxy"), None if r.random() < 0.05 else r.choice("pqrs"), own, i - r.randint(0, 1)))
    return data, spark.createDataFrame(data, f"{name} long, domain string, scenario string, tags array<string>, source long")


@pytest.mark.parametrize("least", [0.1, 1 / 3, 0.5, 0.6, 2 / 3, 0.9, 1.0, 1.2])
def test_contexts_are_those_of_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(adaptive, "block_join", lambda left, right, on: block_join(left, right, on, 15))
    one, b = contexts(spark, 90, "bundle_id", 1)
    two, t = contexts(spark, 80, "target_id", 2)
    wanted = {}
    for i, d, s, tags, source in one:
        for j, d2, s2, tags2, _ in two:
            if None in (d, s, d2, s2) or source == j:
                continue
            x, y = set(tags or []), set(tags2 or [])
            base = (d == d2) + (s == s2)
            score = (base + len(x & y) / len(x | y)) / 3 if x and y else base / 2
            if score >= least:
                wanted[i, j] = score
    got = {(r["bundle_id"], r["target_id"]): r["score"] for r in adaptive.context_fit(b, t.drop("source"), least).collect()}
    assert got == pytest.approx(wanted)


def test_context_edge_cases(spark):
    _, b = contexts(spark, 10, "bundle_id", 3)
    t = b.withColumnRenamed("bundle_id", "target_id").drop("source")
    assert adaptive.context_fit(b.limit(0), t).count() == adaptive.context_fit(b, t.limit(0)).count() == 0
    with pytest.raises(ValueError):
        adaptive.context_fit(b, t, 0)
    same = b.withColumns({"domain": F.lit("d"), "scenario": F.lit("s"), "source": F.lit(None).cast("long")})
    assert adaptive.context_fit(same.unionByName(same), t.withColumns({"domain": F.lit("d"), "scenario": F.lit("s")})).count() == 200  # repeated rows too


def test_a_hot_domain_makes_few_pairs(spark):
    """All contexts share a domain; only those with the same five rare tags are alike. No step of the plan makes the pairs of the domain."""
    def side(name, n):
        tags = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("t"), F.col("id"), F.lit("_"), i))
        return spark.range(n).select(F.col("id").alias(name), F.lit("d").alias("domain"), F.concat(F.lit(name), "id").alias("scenario"), F.array_append(tags, F.lit("common")).alias("tags"), F.lit(None).cast("long").alias("source"))

    found = adaptive.context_fit(side("bundle_id", 20_000), side("target_id", 20_000).drop("source"), 0.6)
    assert found.count() == 20_000 and found.where("bundle_id <> target_id or abs(score - 2 / 3) > 1e-9").isEmpty()


def test_containing_is_every_pair(spark, monkeypatch):
    monkeypatch.setattr(constraints, "block_join", lambda left, right, on: block_join(left, right, on, 10))
    r = random.Random(4)
    words = ["", "a", "aa", "é", "😀x", "prefix shared by all " * 8, *["".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(60)]]
    hay = [*words, *["prefix shared by all " * 8 + w for w in words], *["".join(r.choice("ab😀") for _ in range(r.randint(0, 200))) for _ in range(40)]]
    needles = [*words, *[h[i : i + r.randint(1, 150)] for h in hay[:120] for i in (0, len(h) // 3)]]
    n = spark.createDataFrame([(x,) for x in [*needles, None]], "n string").repartition(3)
    h = spark.createDataFrame([(x,) for x in [*hay, *hay[:5], None]], "h string").repartition(3)
    wanted = {(x, y): 1 for x in needles for y in hay if x in y}
    assert rows_of(constraints.containing(n, h)) == Counter(wanted)
    assert constraints.containing(n.limit(0), h).count() == constraints.containing(n, h.limit(0)).count() == 0


def test_a_common_head_is_no_meeting_place(spark):
    """20,000 rules and requests that begin alike: they meet by their tails."""
    n = spark.range(20_000).select(F.format_string("the movement of unit %05d", "id").alias("n"))
    h = spark.range(20_000).select(F.format_string("the movement of unit %05d", "id").alias("h"))
    found = constraints.containing(n, h)
    assert found.count() == 20_000 and found.where("n <> h").isEmpty()
