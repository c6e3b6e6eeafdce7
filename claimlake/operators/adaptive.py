"""Pattern bundles and adaptive rules: context fit, shadow metrics, performance windows, propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.functions.scalar import context_similarity, improvement_pct
from claimlake.operators import openers
from claimlake.operators.blocks import block_join
from claimlake.runtime import written

#: Thresholds of adoption, promotion and shadow tests.
CONTEXT_AT_LEAST, IMPROVEMENT_AT_LEAST, SAMPLES = 0.6, 0.1, 10
WINDOW_SECONDS, RECENT, PROMOTE, DEMOTE = 300, 5, 0.1, -0.05
SHADOWS, SHADOW_SAMPLES, RING = 5, 50, 100


#: The part of a context's score that an overlap of tags gives beside equal domain and equal scenario.
PARTS = 3
#: What bounds give way for rounding; scores are held to the threshold itself.
SLACK = 1e-9


def _overlapping(b: DataFrame, t: DataFrame, same: list[str], least: float) -> DataFrame:
    """Pairs of tagged contexts that are equal in ``same`` and whose tags have a Jaccard overlap of ``least`` (above 0) or more.

    A prefix join: both sides order their tags from the rarest on, and two sets of that overlap have one in common among the
    first n - ceil(least * n) + 1 of each. What they have left after that tag must still suffice, and their sizes must be near."""
    def tags(df: DataFrame, side: str) -> DataFrame:
        return df.select(f"_{side}", *[F.col(f"{side}_{c}").alias(c) for c in same], F.explode(f"{side}_tags").alias("_tag"))

    seen = tags(b, "b").select("_tag").unionByName(tags(t, "t").select("_tag")).groupBy("_tag").agg(F.count("*").alias("_df"))

    def prefix(df: DataFrame, side: str) -> DataFrame:
        # A null tag is a tag; it joins as a struct, which is not null.
        ranked = tags(df, side).join(seen.withColumnRenamed("_tag", "_known"), F.col("_tag").eqNullSafe(F.col("_known")))
        keys = ranked.groupBy(f"_{side}", *same).agg(F.array_sort(F.collect_list(F.struct("_df", F.struct("_tag").alias("_key")))).alias("_keys")).withColumn(f"_n{side}", F.size("_keys"))
        kept = F.col(f"_n{side}") - F.ceil(least * F.col(f"_n{side}") - SLACK) + 1
        return keys.select(f"_{side}", *same, f"_n{side}", F.posexplode(F.slice("_keys", F.lit(1), kept.cast("int"))).alias(f"_at{side}", "_x")).withColumn("_key", F.col("_x._key")).drop("_x")

    met = block_join(written(prefix(b, "b"), "prefix_b"), written(prefix(t, "t"), "prefix_t"), [*same, "_key"])
    ahead = F.least(F.col("_nb") - F.col("_atb"), F.col("_nt") - F.col("_att"))  # tags from this one on
    enough = ahead >= F.ceil(least / (1 + least) * (F.col("_nb") + F.col("_nt")) - SLACK)
    near = F.least("_nb", "_nt") >= least * F.greatest("_nb", "_nt") - SLACK
    first = met.groupBy("_b", "_t").agg(F.min(F.struct("_atb", enough.alias("_ok"))).alias("_first"), F.first(near).alias("_near"))
    return first.where("_first._ok and _near").select("_b", "_t")


def context_fit(bundles: DataFrame, targets: DataFrame, least: float = CONTEXT_AT_LEAST, skip_self: bool = True) -> DataFrame:
    """bundles (bundle_id, domain, scenario, tags, source) x targets (target_id, domain, scenario, tags) -> pairs whose
    contexts are alike, ``least`` being above 0; a context without domain or scenario is like none.

    Equal contexts are one: distinct contexts meet, then their rows. How much overlap of tags a pair needs follows from what else
    is equal: nothing more (then it is joined on that), all (joined on that and on rare tags, ``_overlapping``), or more than there can be
    (then it is not made). So a domain that all contexts share makes no pairs but those of its answers and of its rare tags, and keys
    that are hot on both sides are cut into blocks."""
    if least <= 0:
        raise ValueError("least has to be above 0: at 0 every pair is alike")

    def contexts(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        tags = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast(df.schema["tags"].dataType))))
        rows = df.where("domain is not null and scenario is not null").withColumn("_tags", tags).withColumn(f"_{side}", F.sha2(F.to_json(F.struct("domain", "scenario", F.transform("_tags", lambda x: F.struct(x.alias("x"))).alias("tags"))), 256))
        rows = written(rows, f"contexts_{side}")
        first = rows.groupBy(f"_{side}").agg(*[F.first(c).alias(f"{side}_{c.strip('_')}") for c in ("domain", "scenario", "_tags")])
        return rows, written(first, f"distinct_{side}")

    b_rows, b = contexts(bundles, "b")
    t_rows, t = contexts(targets, "t")
    tagged = {side: F.size(f"{side}_tags") > 0 for side in "bt"}
    found = []
    for same in (["domain", "scenario"], ["domain"], ["scenario"], []):
        other = [F.col(f"b_{c}") != F.col(f"t_{c}") for c in ("domain", "scenario") if c not in same]
        unlike = reduce(Column.__and__, other, F.lit(True))
        need = PARTS * least - len(same)
        if need <= SLACK:
            plain = [(b, t)]
        else:  # without tags on a side, half of what is equal must do
            plain = [(b, t.where(~tagged["t"])), (b.where(~tagged["b"]), t.where(tagged["t"]))] if len(same) / 2 >= least else []
        keyed = lambda df, side: df.select(f"_{side}", *[F.col(f"{side}_{c}").alias(c) for c in same], *[f"{side}_{c}" for c in ("domain", "scenario")])
        found += [block_join(keyed(x, "b"), keyed(y, "t"), same).where(unlike).select("_b", "_t") for x, y in plain]
        if SLACK < need <= 1 + SLACK:
            pairs = _overlapping(b.where(tagged["b"]), t.where(tagged["t"]), same, min(need, 1.0))
            sides = [df.select(f"_{side}", *[f"{side}_{c}" for c in ("domain", "scenario")]) for df, side in ((b, "b"), (t, "t"))]
            found.append(pairs.join(sides[0], "_b").join(sides[1], "_t").where(unlike).select("_b", "_t") if other else pairs)
    score = context_similarity(*[{c: F.col(f"{side}_{c}") for c in ("domain", "scenario", "tags")} for side in "bt"])
    if not found:  # least is above 1
        return b_rows.join(t_rows, F.lit(False)).selectExpr("bundle_id", "target_id", "0d as score")
    alike = reduce(DataFrame.unionByName, found).join(b, "_b").join(t, "_t").withColumn("score", score).where(F.col("score") >= least).select("_b", "_t", "score")
    alike = written(alike, "alike")
    pairs = block_join(block_join(b_rows.select("_b", "bundle_id", "source"), alike, ["_b"]), t_rows.select("_t", "target_id"), ["_t"])
    return (pairs.where("not (source <=> target_id)") if skip_self else pairs).select("bundle_id", "target_id", "score")


def evaluate(bundles: DataFrame, shadows: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """bundles (bundle_id, context_score, baseline, improved) and shadows (bundle_id, improvement) -> recommendation.
    Without shadow results the reported improvement counts, at stability one half.

    A mean may lie on the threshold, and sums of doubles go by the order of their rows; so improvements are summed as decimals of 18
    places, exactly, and only a bundle with one that is none (from 1e10 on, infinite, not a number) by its doubles. With ``order``,
    columns of shadows, a bundle's doubles are added one by one in that order instead, as an average over rows in turn does: a bundle's rows are
    sorted by one task, which spills."""
    if order:
        turn = Window.partitionBy("bundle_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        shadows = shadows.select("bundle_id", "improvement", F.sum("improvement").over(turn).alias("_sum"), F.row_number().over(turn).alias("_turn"))
        mean = F.try_divide(F.max_by("_sum", "_turn"), F.count("improvement"))
    else:
        exact = F.col("improvement").try_cast("decimal(28,18)")
        inexact = F.count_if(F.col("improvement").isNotNull() & exact.isNull()) > 0
        mean = F.when(inexact, F.avg("improvement")).otherwise(F.avg(exact).cast("double"))
    seen = shadows.groupBy("bundle_id").agg(F.count("*").alias("n"), mean.alias("mean"), F.var_pop("improvement").alias("variance"))
    df = bundles.join(seen, "bundle_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    improvement = F.coalesce("mean", improvement_pct(F.col("baseline"), F.col("improved")) / 100)
    stability = F.when(F.col("n") > 0, 1 / (1 + F.col("variance"))).otherwise(F.lit(0.5))
    df = df.withColumns({"improvement": improvement, "stability": stability})
    verdict = F.when(F.col("context_score") < CONTEXT_AT_LEAST, "reject").when(F.col("improvement") < IMPROVEMENT_AT_LEAST, "reject").when(F.col("n") < SAMPLES, "test_more").otherwise("adopt")
    return df.select("bundle_id", "context_score", "improvement", "stability", "n", verdict.alias("recommendation"))


def shadow_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def latest(rows: DataFrame, key: str, order: str, most: int = RING) -> DataFrame:
    """A ring buffer: the last rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def windows_from_first(records: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """records (rule_id, ts double, value) -> window (number from 0), opened by the first record after the last one
    expired. Records without a rule or time have none and are left out."""
    return openers.windows(records.select("rule_id", "ts", "value"), "rule_id", "ts", seconds)


def judge(windowed: DataFrame, baseline: Column, recent: int = RECENT) -> DataFrame:
    """Mean of the last closed windows against a baseline. ``windowed``: rule_id, window, value; the last window of a
    rule is still open and does not count."""
    per = windowed.groupBy("rule_id", "window").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    back = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("window")))
    closed = per.withColumn("back", back).where(F.col("back").between(2, recent + 1))
    mean = closed.groupBy("rule_id").agg((F.sum("total") / F.sum("n")).alias("mean"))
    rules = windowed.select("rule_id").distinct().join(mean, "rule_id", "left")
    change = F.coalesce(F.try_divide(F.col("mean") - baseline, baseline), F.lit(0.0))
    rules = rules.withColumn("improvement", change)
    verdict = F.when(F.col("improvement") >= PROMOTE, "promote").when(F.col("improvement") <= DEMOTE, "demote").otherwise("maintain")
    return rules.select("rule_id", "improvement", verdict.alias("recommendation"))


def bundle_edges(bundles: DataFrame) -> DataFrame:
    """bundles (bundle_id, rules array<struct<condition, action>> of subject, predicate, object) -> edges."""
    rules = bundles.select("bundle_id", F.explode("rules").alias("r"))
    both = rules.select("bundle_id", F.explode(F.array("r.condition", "r.action")).alias("e"))
    return both.select("bundle_id", "e.subject", "e.predicate", "e.object").where("subject <> '' and predicate <> '' and object <> ''")


def requirements(edges: DataFrame) -> DataFrame:
    """Sorted entities and predicates that a bundle needs."""
    both = F.array_union(F.collect_set("subject"), F.collect_set("object"))
    return edges.groupBy("bundle_id").agg(F.array_sort(both).alias("entities"), F.array_sort(F.collect_set("predicate")).alias("predicates"))


def allowed_sends(sends: DataFrame, per_minute: float) -> DataFrame:
    """sends (bundle_id, ts double) with allowed: one is allowed 60 / per_minute seconds after the last allowed one; of sends
    at one time only one can be."""
    at = sends.where("bundle_id is not null and ts is not null").groupBy("bundle_id", "ts").agg(F.count("*").alias("_n"))
    opened = openers.openers(sends.select(F.col("bundle_id").alias("key"), F.col("ts").alias("t")), 60 / per_minute, strict=False)
    opened = opened.select(F.col("key").alias("bundle_id"), F.col("t").alias("ts"), F.lit(True).alias("_opens"))
    each = at.join(opened, ["bundle_id", "ts"], "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return each.select("bundle_id", "ts", ((F.col("_i") == 1) & F.coalesce("_opens", F.lit(False))).alias("allowed"))


def next_state(state: str, samples: int, recommendation: str, running: int, review: bool = True) -> str:
    """Where a received bundle goes: rejected, testing (while fewer than SHADOWS are), queued; from testing, after
    enough samples, to adopted or to a person."""
    if state == "received":
        return "rejected" if recommendation == "reject" else "testing" if running < SHADOWS else "queued"
    if state == "testing":
        if samples < SHADOW_SAMPLES or recommendation == "test_more":
            return "testing"
        return "rejected" if recommendation == "reject" else "human_review" if review else "adopted"
    return state
