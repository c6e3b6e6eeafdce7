"""References between shards, lineage, and differences between two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.operators.closure import reach
from claimlake.sources import store


def list_references(refs: DataFrame) -> DataFrame:
    return refs.orderBy(F.col("confidence").desc_nulls_last(), "src_claim_id", "dst_object_id")


def cross_shard(claims: DataFrame, refs: DataFrame, targets: DataFrame, most_tier: int = 1) -> DataFrame:
    """Claims up to a tier, with the claims of other shards that they refer to."""
    a = claims.where(F.col("tier") <= most_tier).select(F.col("claim_id").alias("src_claim_id"), F.col("predicate").alias("action"), F.col("object").alias("target"), "tier")
    b = targets.select(F.col("claim_id").alias("dst_object_id"), F.col("predicate").alias("doctrine_predicate"), F.col("object").alias("doctrine_object"))
    out = a.join(refs.select("src_claim_id", "dst_object_id", "relation_type", "confidence"), "src_claim_id").join(b, "dst_object_id")
    return out.select("src_claim_id", "action", "target", "tier", "relation_type", "confidence", "dst_object_id", "doctrine_predicate", "doctrine_object")


def cross_shard_spans(claims: DataFrame, refs: DataFrame, spans: DataFrame, shard: str, most_tier: int = 1, limit: int = 10) -> DataFrame:
    """Claims that refer to a shard, beside the evidence of that shard's first source."""
    first = spans.agg(F.min("source_hash").alias("source_hash"))
    evidence = spans.join(F.broadcast(first), "source_hash").select("span_id", F.left("text", F.lit(120)).alias("doctrine_evidence"))
    cited = refs.where(F.col("dst_shard_id") == shard).select(F.col("src_claim_id").alias("claim_id"), "relation_type", "confidence")
    a = claims.where(F.col("tier") <= most_tier).join(cited, "claim_id").select("claim_id", F.col("predicate").alias("action"), "tier", F.col("relation_type").alias("relation"), "confidence")
    # Only the first ``limit`` of either side can be among the first ``limit`` pairs of this order.
    order = ["tier", F.col("confidence").desc(), "claim_id", "relation"]
    a = a.orderBy(*order).limit(limit)
    return a.crossJoin(evidence.orderBy("span_id").limit(limit)).orderBy(*order, "span_id").limit(limit)


def reference_integrity(refs: DataFrame, mounted: DataFrame) -> DataFrame:
    """References by target shard, and whether it is mounted. ``mounted``: shard_id."""
    known = mounted.select(F.col("shard_id").alias("dst_shard_id")).distinct().withColumn("here", F.lit(True))
    counts = refs.groupBy("dst_shard_id").agg(F.count("*").alias("n_refs"))
    return counts.join(known, "dst_shard_id", "left").select("dst_shard_id", "n_refs", F.when(F.col("here"), "MOUNTED").otherwise("BROKEN").alias("status"))


def broken_references(refs: DataFrame, claims: DataFrame) -> DataFrame:
    """References to claims that no mounted shard has."""
    return refs.where("dst_object_type = 'claim'").join(claims.select(F.col("claim_id").alias("dst_object_id")), "dst_object_id", "left_anti")


def lineage_closure(lineage: DataFrame) -> DataFrame:
    """root, cur, depth: everything that a shard supersedes, directly or through others, with the fewest steps; never
    itself. Found by doubling, so a chain of n takes log2(n) rounds."""
    found = reach(lineage.select(F.col("shard_id").alias("a"), F.col("supersedes_shard_id").alias("b")))
    return found.select("root", "cur", "depth")


def _same(left: DataFrame, keys: list[str]) -> Column:
    rest = [c for c in left.columns if c not in keys]
    return F.struct(*[F.col(f"b.{c}") for c in rest]).eqNullSafe(F.struct(*[F.col(f"d.{c}") for c in rest]))


def added(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return delta.join(base.select(*keys), keys, "left_anti").select(*keys)


def removed(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return added(delta, base, keys)


def modified(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both sides whose rows differ in another column; null equals null."""
    on = [F.col(f"b.{k}") == F.col(f"d.{k}") for k in keys]
    rest = delta.select(*base.columns)
    return base.alias("b").join(rest.alias("d"), on).where(~_same(base, keys)).select(*[F.col(f"b.{k}").alias(k) for k in keys])


def diff(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """key columns and change (added, removed, modified) in one full outer join."""
    rest = [c for c in base.columns if c not in keys]
    b = base.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.struct(*rest).alias("b_row"))
    d = delta.select(*[F.col(k).alias(f"d_{k}") for k in keys], F.struct(*rest).alias("d_row"))
    both = b.join(d, [F.col(f"b_{k}") == F.col(f"d_{k}") for k in keys], "full")
    change = F.when(F.col("b_row").isNull(), "added").when(F.col("d_row").isNull(), "removed").when(~F.col("b_row").eqNullSafe(F.col("d_row")), "modified")
    return both.select(*[F.coalesce(f"b_{k}", f"d_{k}").alias(k) for k in keys], change.alias("change")).where("change is not null")


def diff_packs(spark: SparkSession, base: str, delta: str) -> DataFrame:
    """kind, id, change between two folders with concepts.jsonl and relations.jsonl (a missing file has no rows): objects by
    id, the last of equal ids; the order of an object's keys does not matter."""

    def pack(folder: str, kind: str) -> DataFrame:
        path = f"{folder}/{kind}.jsonl"
        lines = spark.read.text(path) if store.exists(spark, path) else spark.createDataFrame([], "value string")
        rows = lines.where("trim(value) <> ''").select(F.get_json_object("value", "$.id").alias("id"), F.to_json(F.parse_json("value")).alias("body"), F.monotonically_increasing_id().alias("at"))
        return rows.where("id <> ''").groupBy("id").agg(F.max_by("body", "at").alias("body"))

    parts = [diff(pack(base, kind), pack(delta, kind), ["id"]).select(F.lit(kind).alias("kind"), "id", "change") for kind in ("concepts", "relations")]
    return parts[0].unionByName(parts[1])


def diff_summary(changes: DataFrame, key: str, most: int = 200) -> dict:
    """Counts, and the first ``most`` keys of each change (a report's limit)."""
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    out: dict = {}
    for name in ("added", "removed", "modified"):
        ids = [r[0] for r in changes.where(F.col("change") == name).select(key).orderBy(key).limit(most).collect()]
        out[name] = {"count": counts.get(name, 0), "ids": ids}
    return out


def topology_hash(edges: DataFrame, form: str = "prefixed") -> DataFrame:
    """One row: the hash of an edge multiset, whatever its order. Each edge is hashed with length prefixes (the older
    ``form`` "delimited" joins the parts by a bar), equal edges count; sums of the digests' eight words need no gathering
    of the edges."""
    if form not in ("prefixed", "delimited"):
        raise ValueError(form)
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    names = ("subject", "predicate", "object")
    digest = F.sha2(F.concat(*map(part, names)) if form == "prefixed" else F.concat_ws("|", *names), 256)
    words = edges.select(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)").alias(f"w{i}") for i in range(8)])
    sums = words.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(8)])
    return sums.select(F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(8)]), 256).alias("topology_hash"), F.col("n").alias("n_edges"))


def edges(claims: DataFrame) -> DataFrame:
    """subject, predicate, object; rows with an empty part are left out."""
    return claims.select("subject", "predicate", "object").where("subject <> '' and predicate <> '' and object <> ''")


def edges_of_args(claims: DataFrame) -> DataFrame:
    """Edges of n-ary claims (predicate, args array<struct<role, entity_id>>): the last subject and the last object."""
    of = lambda role: F.try_element_at(F.filter("args", lambda a: a["role"] == role), F.lit(-1))["entity_id"]
    return claims.select(of("subject").alias("subject"), "predicate", of("object").alias("object")).where("subject is not null and object is not null")
