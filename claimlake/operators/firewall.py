"""Answers held to their citations, sentence by sentence, for many answers at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
#: Beginnings of sentences that claim no fact.
SAFE = ("i cannot", "based on", "the context", "the provided", "according to", "in summary", "to summarize", "note that", "however", "therefore", "additionally", "also")
SHORT = 20


def citations(text: Column) -> Column:
    """Sorted distinct numbers in square brackets."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda n: F.trim(n).cast("int"))
    return F.array_sort(F.array_distinct(numbers))


def sentences(answers: DataFrame, *keep: str) -> DataFrame:
    """answers (answer_id, answer) -> answer_id, pos, sentence and the columns ``keep`` of the answer; sentences end in . ! or ?"""
    parts = F.split("answer", r"(?<=[.!?])\s+", -1)
    rows = answers.select("answer_id", *keep, F.posexplode(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))).alias("pos", "sentence"))
    return rows.where("sentence <> ''")


def check(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer, valid_ids array<int>) -> each sentence with cites, invalid and status: verified,
    fabricated (cites what is not in the context), uncited (states a fact without a source) or pass."""
    s = sentences(answers.where("answer_id is not null"), "valid_ids").withColumn("cites", citations(F.col("sentence")))
    s = s.withColumn("invalid", F.array_except("cites", "valid_ids"))
    exempt = (F.length("sentence") < SHORT) | F.col("sentence").endswith("?") | reduce(Column.__or__, [F.lower("sentence").startswith(p) for p in SAFE])
    cited = F.size("cites") > 0
    status = F.when(cited & (F.size("invalid") > 0), "fabricated").when(cited, "verified").when(exempt, "pass").otherwise("uncited")
    return s.select("answer_id", "pos", "sentence", "cites", "invalid", status.alias("status"))


def verdict(checked: DataFrame) -> DataFrame:
    uncited, fabricated = F.count_if(F.col("status") == "uncited"), F.count_if(F.col("status") == "fabricated")
    return checked.groupBy("answer_id").agg(uncited.alias("n_uncited"), fabricated.alias("n_fabricated"), (uncited + fabricated == 0).alias("clean"))


def resolve_citations(checked: DataFrame, context: DataFrame) -> DataFrame:
    """Each citation with the claim that it stands for; ``context``: cite, claim_id. No claim: fabricated."""
    each = checked.select("answer_id", "pos", F.explode("cites").alias("cite"))
    return each.join(context.select("cite", "claim_id"), "cite", "left").withColumn("fabricated", F.col("claim_id").isNull())
