"""Questions to plans: a question is read into an intent, and an intent builds a DataFrame plan. No text of the
question is ever spliced into SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.functions.scalar import clean_topic

#: Predicates that record a decision; months; words that no keyword search looks for.
DECISIONS = (
    "decided", "chose", "selected", "rejected", "confirmed", "proposed", "revised", "superseded", "approved", "committed", "adopted",
    "abandoned", "deferred", "pivoted", "discovered",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
COMMON = (
    "what", "when", "where", "which", "that", "this", "have", "from", "with", "about", "show", "find", "tell", "give", "list", "know", "does",
    "your", "were", "there", "their", "would", "could", "should",
)
LIMIT = 50
DEFAULT_YEAR = "2026"
TITLE = "has_title"
#: Phrases and patterns that tell what a question asks for; the first kind that fits counts. A pattern's
#: group is the topic.
PHRASES = {
    "contradictions": ("contradict", "conflict", "inconsisten"),
    "timeline": ("timeline", "history of", "chronolog"),
    "staleness": ("stale", "outdat", "not review", "coverage", "old decision"),
    "lineage": ("supersed", "replaced", "lineage", "version chain"),
    "all_decisions": ("all decision", "what decision", "list decision", "every decision", "our decision"),
    "list_titles": ("all conversations", "list all", "show all", "everything"),
}
PATTERNS = {
    "timeline": r"(?:timeline|history)\s+(?:of|for)\s+(.+?)(?:\?|$)",
    "changed_since": r"(?:changed since|new since|since|after|from)\s+(\d{4}-\d{2}-\d{2}|(?:" + "|".join(MONTHS) + r")\s*\d{0,4})",
    "decisions_about": r"(?:decided?|decision).{0,20}(?:about|on|for|regarding)\s+(.+?)(?:\?|$)",
    "topic": r"(?:about|regarding|related to|involving|mention(?:ing)?)\s+(.+?)(?:\?|$)",
    "show_find": r"(?:show|find|search|get|list)\s+(?:me\s+)?(?:all\s+)?(.+?)(?:\?|$)",
}
LEADING = r"^(?:my|the|all|conversations?|about)\s+"
ORDER = ("contradictions", "timeline", "staleness", "lineage", "changed_since", "decisions_about", "all_decisions", "list_titles", "topic", "show_find")


@dataclass(frozen=True)
class Intent:
    kind: str
    topic: str | None = None
    since: str | None = None
    words: tuple[str, ...] = field(default=())
    limit: int = LIMIT


def _since(text: str, year: str) -> str:
    for number, month in enumerate(MONTHS, 1):
        if month in text:
            found = re.search(r"\d{4}", text)
            return f"{found[0] if found else year}-{number:02d}-01"
    return text


def _read(kind: str, q: str) -> str | None:
    """The topic if ``q`` is of this kind, empty where the kind has none; None if it is not."""
    if kind in PHRASES and not any(phrase in q for phrase in PHRASES[kind]):
        return None
    found = re.search(PATTERNS[kind], q) if kind in PATTERNS else None
    if found is None:
        return "" if kind in PHRASES else None
    topic = clean_topic(found[1])
    return (re.sub(LEADING, "", topic).strip() or None) if kind == "show_find" else topic


def parse(question: str, limit: int = LIMIT, default_year: str = DEFAULT_YEAR) -> Intent:
    """The first kind in ORDER that a question is of; else its keywords; else the titles."""
    q = question.lower().strip()
    for kind in ORDER:
        topic = _read(kind, q)
        if topic is not None:
            return Intent(kind, since=_since(topic, default_year), limit=limit) if kind == "changed_since" else Intent(kind, topic or None, limit=limit)
    words = tuple(w for w in re.split(r"\W+", q) if len(w) > 3 and w not in COMMON)
    return Intent("keyword", words=words[:4], limit=limit) if words else Intent("titles", limit=limit)


def _mentions(topic: str) -> Column:
    return F.lower("object").contains(topic) | F.lower("subject").contains(topic)


def _dated(claims: DataFrame, temporal: DataFrame) -> DataFrame:
    dates = temporal.select("claim_id", "valid_from", "valid_until")
    return claims.where(F.col("predicate").isin(*DECISIONS)).join(dates, "claim_id", "left")


def _contradictions(claims: DataFrame, limit: int) -> DataFrame:
    """Pairs of unlike decisions of one subject and predicate, among which the first ``limit`` in order are: only the
    first groups that have any, and of a group only so many first members as have a later unlike one, meet the rest."""
    key = ["subject", "predicate"]
    made = claims.where(F.col("predicate").isin(*DECISIONS)).select(*key, "object", "shard_id", "claim_id")
    unlike = made.groupBy(*key).agg(F.min("object").alias("_low"), F.max("object").alias("_high")).where("_low < _high")
    some = made.join(F.broadcast(unlike.orderBy(*key).limit(limit).select(*key)), key)
    later = Window.partitionBy(*key).orderBy("claim_id").rowsBetween(1, Window.unboundedFollowing)
    first = some.withColumns({"_low": F.min("object").over(later), "_high": F.max("object").over(later)}).where("_low <> object or _high <> object")
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("claim_id"))).where(F.col("_k") <= limit)
    a, b = (df.select(*key, F.col("object").alias(f"decision_{x}"), F.col("shard_id").alias(f"shard_{x}"), F.col("claim_id").alias(f"claim_{x}")) for df, x in ((first, "a"), (some, "b")))
    return a.join(b, key).where("decision_a <> decision_b and claim_a < claim_b")


def build(intent: Intent, claims: DataFrame, temporal: DataFrame, lineage: DataFrame) -> DataFrame:
    """The plan of an intent over claims whose subjects and objects are labels. Every limit follows a total order."""
    dated = _dated(claims, temporal).withColumnRenamed("valid_from", "decided_at")
    shown = ["subject", "predicate", "object", "decided_at", "shard_id"]
    ties = [F.col(c).asc_nulls_last() for c in ("subject", "predicate", "object", "claim_id")]
    by_time = [F.col("decided_at").asc_nulls_last(), *ties]
    if intent.kind == "contradictions":
        pairs = _contradictions(claims, intent.limit)
        return pairs.orderBy("subject", "predicate", "claim_a", "claim_b").limit(intent.limit).select("subject", "predicate", "decision_a", "decision_b", "shard_a", "shard_b")
    if intent.kind in ("timeline", "all_decisions"):
        found = dated.where(_mentions(intent.topic)) if intent.topic else dated
        return found.orderBy(*by_time).limit(intent.limit).select(*shown)
    if intent.kind == "staleness":
        open_ended = dated.where("valid_until is null or valid_until = ''")
        return open_ended.orderBy(F.col("decided_at").asc_nulls_first(), *ties).limit(intent.limit).select(*shown, "valid_until")
    if intent.kind == "lineage":
        rows = lineage.select(F.col("shard_id").alias("current_shard"), F.col("supersedes_shard_id").alias("replaced_shard"), "action", "timestamp", "note")
        return rows.orderBy(F.col("timestamp").desc_nulls_last(), "current_shard", "replaced_shard").limit(intent.limit)
    if intent.kind == "changed_since":
        return dated.where(F.col("decided_at") >= intent.since).orderBy(*by_time).limit(intent.limit).select(*shown)
    if intent.kind == "decisions_about":
        return dated.where(_mentions(intent.topic)).select(*shown).distinct().orderBy(*by_time[:4])
    titles = claims.where(F.col("predicate") == TITLE).select("subject", F.col("object").alias("title")).distinct()
    if intent.kind in ("list_titles", "titles"):
        titles = titles.orderBy("subject", "title")
        return titles.limit(intent.limit) if intent.kind == "titles" else titles
    if intent.kind == "topic":
        hits = claims.where((F.col("predicate") == TITLE) | _mentions(intent.topic)).select(F.col("subject").alias("conversation")).distinct()
        return hits.join(titles, F.col("conversation") == F.col("subject")).select("conversation", "title").orderBy(F.col("title").asc_nulls_last(), "conversation")
    rows = claims.where(_mentions(intent.topic) if intent.kind == "show_find" else reduce(Column.__or__, map(_mentions, intent.words)))
    return rows.select("subject", "predicate", "object", "shard_id").distinct().orderBy("subject", "predicate", "object", "shard_id").limit(intent.limit)


def ask(question: str, claims: DataFrame, temporal: DataFrame, lineage: DataFrame, limit: int = LIMIT) -> DataFrame:
    return build(parse(question, limit), claims, temporal, lineage)
