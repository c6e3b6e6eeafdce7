"""Pattern extractors: places of many matches, documents dealt out before the work, patterns run once."""

import re

from claimlake import registry
from claimlake.operators import extract
from claimlake.plans import stores, tables
from pyspark.sql import functions as F


def test_places_of_many_matches(spark):
    text = "".join(f"{'é' * (i % 5)}. per § {i} " for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, "per § 7"), (3, "none"), (4, None), (5, "")], "doc_id long, text string")
    df = extract.matches(docs, extract.UNDER, 1)
    found = sorted((r["doc_id"], r["k"], r["g0"], r["g1"], r["at"]) for r in df.collect())
    want = [(1, k, m[0], m[1], m.start()) for k, m in enumerate(re.finditer(extract.UNDER, text))]
    assert found == [*want, (2, 0, "per § 7", "7", 0)] and len(want) == 200
    made = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in made[: made.index("Generate")]  # places are added up once a document, not once a match


def test_documents_of_a_small_file_are_dealt_out(spark, sf):
    parts = []

    def find(docs):
        parts.append(docs.rdd.getNumPartitions())
        return extract.statute_mentions(docs)

    tables._markdown(spark, sf, find)
    assert parts[0] >= 2 * spark.sparkContext.defaultParallelism


def test_candidates_are_found_once(spark):
    rows, runs = 40, spark.sparkContext.accumulator(0)

    @F.udf("string")
    def evidence(text):
        runs.add(1)
        return text[:3]

    docs = spark.createDataFrame([(i, f"{i:03} here") for i in range(rows)], "doc_id long, text string")
    got = extract.in_source(docs.select("doc_id", evidence("text").alias("evidence")), docs)
    assert sorted(r["evidence"] for r in got.collect()) == [f"{i:03}" for i in range(rows)] and runs.value == rows


def test_generators_run_over_documents_dealt_out(spark, sf, monkeypatch):
    parts = []
    monkeypatch.setattr(registry, "run", lambda docs, enabled: parts.append(docs.rdd.getNumPartitions()) or docs.withColumns({"generator": F.lit("x"), "pass": F.lit(0)}))
    stores.generators(spark, sf)
    assert parts[0] >= 2 * spark.sparkContext.defaultParallelism
