"""Evaluation of requests against constraint claims and chains of authority, for many requests at once.

``requests``: request_id, actor, action, target. ``claims``: claim_id, subject, predicate, object, shard_id as labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.scalar import within_validity
from claimlake.operators.blocks import block_join
from claimlake.operators.closure import follow
from claimlake.runtime import written

#: Kinds of constraint from the strongest to the weakest.
PRECEDENCE = ("ROE", "FSCM", "ACM", "WCS", "FPCON", "EMCON", "JRFL", "GUIDANCE")
RULES = ("PROHIBITS", "PERMITS", "REQUIRES", "APPLIES_TO")
ORDER = ("shard_id", "claim_id")


def constraint_kind(subject: Column, obj: Column) -> Column:
    named = [F.when(F.lower(subject).contains(k.lower()) | F.lower(obj).contains(k.lower()), k) for k in PRECEDENCE[:-1]]
    return F.coalesce(*named, F.lit(PRECEDENCE[-1]))


#: Lengths of the character runs by which strings meet.
RUNS = (1, 2, 4, 8, 16, 32, 64)


def containing(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """Distinct strings (n) and (h) -> the pairs (n, h) in which h contains n; the empty needle is in all.

    A needle's key is its head or its tail of the greatest length of ``RUNS`` that it has, at least half of it up to 128
    characters, and whichever of the two fewer haystacks have: a common head does not make it meet all that begin so. Of the
    haystacks' runs of those lengths only those that are some needle's head or tail are kept (by hash; the strings are compared
    when they meet), and a needle of which one is nowhere is in nothing. What is left of hot keys is joined in blocks."""
    n = needles.select("n").where("n is not null").distinct()
    length = F.greatest(*[F.when(F.length("n") >= k, F.lit(k)) for k in RUNS], F.lit(0))
    n = written(n.withColumn("_length", length).withColumn("_keys", F.array_distinct(F.array(F.xxhash64(F.left("n", "_length")), F.xxhash64(F.right("n", "_length"))))), "needles")
    lengths = sorted(n.agg(F.collect_set("_length")).first()[0])  # at most eight
    h = haystacks.select("h").where("h is not null").distinct()

    def runs_of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("h") - k + 1)
        return F.when(F.length("h") >= k, F.transform(starts, lambda i: F.xxhash64(F.substr("h", i, F.lit(k)))) if k else F.array(F.xxhash64(F.lit(""))))

    runs = [runs_of(k) for k in lengths]
    runs = F.array_distinct(F.concat(*[F.coalesce(r, F.array().cast("array<bigint>")) for r in runs])) if runs else F.array().cast("array<bigint>")
    asked = n.select(F.explode("_keys").alias("_key")).distinct()
    keyed = written(h.select("h", F.explode(runs).alias("_key")).join(asked, "_key", "left_semi"), "runs")
    seen = keyed.groupBy("_key").agg(F.count("*").alias("_df"))
    rare = n.select("n", F.explode("_keys").alias("_key")).join(seen, "_key", "left").groupBy("n").agg(F.min(F.struct("_df", "_key")).alias("_least"), F.count_if(F.col("_df").isNull()).alias("_nowhere"))
    rare = written(rare.where("_nowhere = 0").select("n", F.col("_least._key").alias("_key")), "rare")
    return block_join(rare, keyed, ["_key"]).where(F.col("h").contains(F.col("n"))).select("n", "h")


def matches(requests: DataFrame, claims: DataFrame, *, now: Column | None = None) -> DataFrame:
    """Every rule that mentions a request's action or target, or is mentioned by it. An empty subject or object is
    mentioned by all. The distinct strings of both sides meet once, by their character runs, then rows meet by their
    strings; no rule is held against every request. ``now`` also enforces validity windows (valid_from, valid_until of the
    claims)."""
    rules = claims.withColumn("predicate", F.upper("predicate")).where(F.col("predicate").isin(*RULES))
    if now is not None:
        rules = rules.where(within_validity(now, F.col("valid_from"), F.col("valid_until")))
    rules = written(rules.select(*ORDER, "predicate", "subject", "object"), "rules")

    def said(df: DataFrame, key: str, **columns: Column) -> DataFrame:
        """key, role, x: the lower-case strings of a row under the letter of their column."""
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.lower(c).alias("x")) for role, c in columns.items()])).alias("s")).select(key, "s.role", "s.x").where("x is not null")

    asked = written(said(requests, "request_id", a=F.col("action"), t=F.col("target")), "asked")
    ruled = written(said(rules, "claim_id", s=F.coalesce("subject", F.lit("")), o=F.coalesce("object", F.lit(""))), "ruled")
    strings = written(asked.select("x").distinct().unionByName(ruled.select("x").distinct()).distinct(), "strings")
    pairs = containing(strings.select(F.col("x").alias("n")), strings.select(F.col("x").alias("h")))
    # A request's words in a rule's; a rule's subject in the action, its object in the target.
    within = written(pairs.where("n <> h").unionByName(strings.select(F.col("x").alias("n"), F.col("x").alias("h"))), "within")
    one = asked.withColumnRenamed("x", "n").join(within, "n").join(ruled.select("claim_id", F.col("x").alias("h")), "h").select("request_id", "claim_id")
    part = F.when(F.col("role") == "s", "a").otherwise("t")
    two = ruled.select("claim_id", part.alias("role"), F.col("x").alias("n")).join(within, "n").join(asked.withColumnRenamed("x", "h"), ["role", "h"]).select("request_id", "claim_id")
    touching = one.unionByName(two).distinct()
    kind = constraint_kind(F.col("subject"), F.col("object"))
    reason = F.concat(F.lit("predicate="), "predicate", F.lit(" subject="), F.left(F.coalesce("subject", F.lit("")), F.lit(40)))
    return touching.join(rules, "claim_id").select("request_id", "claim_id", "shard_id", "predicate", kind.alias("constraint_type"), reason.alias("match_reason"), F.lit(1.0).alias("weight"))


def authority_chain(actors: DataFrame, claims: DataFrame) -> DataFrame:
    """actor, chain (from the actor up), cycle: DELEGATES_TO leads from a subject to its object, the last one
    recorded counts, and a chain stops where it would repeat. Chains are found by doubling."""
    last = claims.where(F.upper("predicate") == "DELEGATES_TO").groupBy("subject").agg(F.max_by("object", F.struct(*ORDER)).alias("object"))
    walked = follow(actors.select(F.col("actor").alias("start")), last.select(F.col("subject").alias("node"), F.col("object").alias("to")))
    steps = F.sort_array(F.collect_list(F.struct("pos", "node")))
    return walked.groupBy(F.col("start").alias("actor")).agg(F.transform(steps, lambda x: x["node"]).alias("chain"), F.max("again").alias("cycle"))


def revoked(claims: DataFrame) -> DataFrame:
    return claims.where(F.upper("predicate") == "REVOKES").select(F.upper(F.coalesce("object", F.lit(""))).alias("revoked")).distinct()


def decide(requests: DataFrame, claims: DataFrame, *, all_revocations: bool = False, **options) -> DataFrame:
    """-> one row per request: status, controlling_constraint, constraint_type, n_matches, chain, notes, confidence.
    FSCM controls where there is one, else the strongest kind, else the first claim by shard and id. Of the revocations
    a request's notes name those of the actor and of those whom the actor's chain goes up to; ``revoked`` gives all once, and
    ``all_revocations`` puts all into every row, for a few requests."""
    found = matches(requests, claims, **options)
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("constraint_type"))
    order = F.struct((F.col("constraint_type") != "FSCM").cast("int"), rank, *ORDER)
    first = found.groupBy("request_id").agg(F.min_by(F.struct("claim_id", "predicate", "constraint_type"), order).alias("m"), F.count("*").alias("n_matches"))
    first = first.select(F.col("request_id").alias("_r"), "m.*", "n_matches")
    note = F.concat(F.lit("delegation_revoked:"), F.coalesce("object", F.lit("")))
    gone = claims.where(F.upper("predicate") == "REVOKES").groupBy(F.upper(F.coalesce("object", F.lit(""))).alias("revoked")).agg(F.collect_set(note).alias("gone"))
    chains = written(authority_chain(requests, claims), "chains")
    up = chains.select("actor", F.explode("chain").alias("above")).join(gone, F.upper("above") == F.col("revoked"))
    noted = up.groupBy("actor").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("revocations"), F.max(F.upper("above") == F.upper("actor")).alias("is_revoked"))
    actors = chains.join(noted, "actor", "left")
    out = requests.join(first, F.col("request_id") == F.col("_r"), "left").join(actors, "actor", "left")
    out = out.withColumn("is_revoked", F.coalesce("is_revoked", F.lit(False)))
    every = claims.agg(F.count("*").alias("n_claims"), *([F.array_sort(F.collect_set(F.when(F.upper("predicate") == "REVOKES", note))).alias("all_gone")] if all_revocations else []))
    out = out.crossJoin(F.broadcast(every))  # one row
    nothing = F.array().cast("array<string>")
    verdict = F.when(F.col("predicate") == "PROHIBITS", "deny").when(F.col("predicate") == "PERMITS", "permit").otherwise("conditional")
    out = out.withColumn("status", F.when(F.col("claim_id").isNull() | F.col("is_revoked"), "deny").otherwise(verdict))
    confidence = F.when(F.col("n_claims") == 0, 0.0).when(F.col("claim_id").isNull(), 0.5).when(F.col("status") == "permit", 0.9).when(F.col("status") == "deny", 0.85).otherwise(0.6)
    some = [
        F.col("all_gone") if all_revocations else F.coalesce("revocations", nothing),
        F.when(F.col("cycle"), F.array(F.lit("delegation_cycle_detected"))).otherwise(nothing),
        F.when(F.col("claim_id").isNull(), F.array(F.lit("deny_by_default"))).when(F.col("is_revoked"), F.array(F.concat(F.lit("actor_authority_revoked:"), "actor"))).otherwise(nothing),
    ]
    notes = F.when(F.col("n_claims") == 0, F.array(F.lit("no_constraint_shards_mounted"))).otherwise(F.concat(*some))
    return out.select(
        "request_id", "status", F.col("claim_id").alias("controlling_constraint"), "constraint_type", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("chain", F.array("actor")).alias("chain"), notes.alias("notes"), confidence.alias("confidence")
    )
