"""Shards: a folder of Parquet tables with a manifest, a Merkle root over every file, and a signature."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake import schema
from claimlake.functions import ids
from claimlake.operators import validate
from claimlake.operators.prefix import running
from claimlake.runtime import written
from claimlake.sources import store

SPEC = "1.0.0"
SEALED = ("graph", "evidence", "content", "ext")
PLACES = {"claims": "graph", "entities": "graph", "provenance": "graph", "spans": "evidence"}


class ShardError(ValueError):
    """``code`` names what is wrong: LAYOUT, MANIFEST, NULL, SCHEMA, ORPHAN, SOURCE, MERKLE, SIGNATURE, BOUNDS."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


#: Leaves of a subtree that one task hashes; a power of two, so that subtrees are whole nodes of the tree above.
SUBTREE = 1024
SUITES = ("promote", "duplicate")


def _leaf(data: bytes, suite: str) -> bytes:
    return hashlib.sha256(data if suite == "duplicate" else b"\x00" + data).digest()


def _above(level: list[bytes], suite: str) -> list[bytes]:
    """The next level up. Suite ``promote`` tells leaves and nodes apart and carries an odd node up as it is; the older
    ``duplicate`` hashes them alike and pairs an odd node with itself."""
    if suite == "duplicate":
        return [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    return [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]


def merkle_root(leaves: list[bytes], suite: str = "promote") -> str:
    """SHA-256 over leaves and nodes."""
    if suite not in SUITES:
        raise ValueError(suite)
    level = [_leaf(x, suite) for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = _above(level, suite)
    return level[0].hex()


def _subtree(suite: str, subtree: int, raw: bool, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Neighbours (i, hash) to the node above all of them; beside others, an only node still has its levels to go."""

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        level = [_leaf(x, suite) if raw else x for x in frame.sort_values("i")["hash"]]
        rounds = 0
        while len(level) > 1 or (not last and suite == "duplicate" and 1 << rounds < subtree):
            level, rounds = _above(level, suite), rounds + 1
        return pd.DataFrame({"i": [frame["i"].iloc[0] // subtree], "hash": [bytes(level[0])]})

    return up


def merkle_tree(leaves: DataFrame, order: str, leaf: str, suite: str = "promote", subtree: int = SUBTREE) -> DataFrame:
    """leaves (order, leaf: string or binary) of any number -> one row: root, n_leaves; the root that ``merkle_root`` gives of
    them in order. Leaves are numbered by ranges of the order; a subtree of ``subtree`` neighbours is one row of its task, and
    its root a leaf of the next round, until there is one."""
    if suite not in SUITES:
        raise ValueError(suite)
    n = leaves.count()
    if not n:
        return leaves.sparkSession.createDataFrame([(merkle_root([], suite), 0)], "root string, n_leaves long")
    placed = running(leaves.select(F.col(order).alias("order"), F.col(leaf).cast("binary").alias("hash"), F.lit(1).alias("one")), "one", ["order", "hash"])
    nodes = placed.select(F.col("before").cast("long").alias("i"), "hash")
    left, first = n, True
    while first or left > 1:
        up = _subtree(suite, subtree, first, left <= subtree)
        nodes = written(nodes.groupBy(F.floor(F.col("i") / subtree)).applyInPandas(up, "i long, hash binary"), "nodes")
        left, first = -(-left // subtree), False
    return nodes.select(F.lower(F.hex("hash")).alias("root"), F.lit(n).cast("long").alias("n_leaves"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path (below the shard) and sha256 of each sealed file, hashed where they are read."""
    parts = [f"{path}/{n}" for n in store.names(spark, path) if n in SEALED]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(parts)
    folder = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    relative = F.regexp_replace("path", f"^.*?/{folder}/(?=(?:{'|'.join(SEALED)})/)", "")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256")).where("not (endswith(path, '_SUCCESS') or endswith(path, '.crc'))")


def root_of(spark: SparkSession, path: str) -> str:
    """The Merkle root; the driver sees one hash for each file."""
    return merkle_root([f"{r['path']}:{r['sha256']}".encode() for r in file_hashes(spark, path).orderBy("path").collect()])


def compile_shard(candidates: DataFrame, sources: DataFrame, out: str, *, namespace: str = "default", extensions: dict[str, DataFrame] | None = None, key: bytes | None = None) -> dict:
    """candidates (doc_id, subject, predicate, object, object_type, evidence, byte_start, byte_end, tier) over sources
    (doc_id, text) -> a sealed shard; the manifest is returned. Tables are sorted by key; extensions are derived
    before the seal, so the root covers them. Candidates with the source_hash of their text are not joined to the sources for it."""
    spark = candidates.sparkSession
    ns = F.lit(namespace)
    hashed = sources.select("doc_id", ids.source_hash(F.col("text")).alias("source_hash"), "text")
    c = candidates if "source_hash" in candidates.columns else candidates.join(hashed.select("doc_id", "source_hash"), "doc_id")
    c = c.withColumn("s_id", ids.entity_id(ns, F.col("subject")))
    o_id = F.when(F.col("object_type") == "entity", ids.entity_id(ns, F.col("object"))).otherwise(F.col("object"))
    c = c.withColumn("o_id", o_id).withColumn("claim_id", ids.claim_id(F.col("s_id"), F.col("predicate"), F.col("o_id"), F.col("object_type")))
    span = [F.col(x) for x in ("source_hash", "byte_start", "byte_end")]
    tables = {
        "claims": c.groupBy("claim_id", F.col("s_id").alias("subject"), "predicate", F.col("o_id").alias("object"), "object_type").agg(F.min("tier").cast("int").alias("tier")),
        "entities": c.select(F.col("s_id").alias("entity_id"), F.col("subject").alias("label")).union(c.where("object_type = 'entity'").select("o_id", "object")).distinct(),
        "provenance": c.select(ids.b32_id("p_", F.col("claim_id"), *span).alias("provenance_id"), "claim_id", *span),
        "spans": c.select(ids.span_id(*span, F.col("evidence")).alias("span_id"), *span, F.col("evidence").alias("text")),
    }
    for name, df in tables.items():
        key_cols = schema.KEYS[name]
        ranges = df.repartitionByRange(*key_cols)
        if name in ("provenance", "spans"):  # nearly all rows are distinct, and equal ones of one range: they go once there, without a shuffle of their own
            ranges = ranges.distinct()
        ranges.sortWithinPartitions(*key_cols).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{PLACES[name]}/{name}.parquet")
    for name, df in (extensions or {}).items():
        key_cols = schema.KEYS.get(name.split("@")[0], df.columns[:1])
        df.sortWithinPartitions(*key_cols).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/ext/{name}.parquet")
    hashed.select("source_hash", "text").dropDuplicates(["source_hash"]).withColumn("size", F.octet_length("text").cast("long")).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/content/sources.parquet")
    root = root_of(spark, out)
    manifest = {"spec_version": SPEC, "shard_id": f"shard_{root}", "namespace": namespace, "integrity": {"merkle_root": root}}
    body = json.dumps(manifest, sort_keys=True).encode()
    store.write_bytes(spark, f"{out}/manifest.json", body)
    if key:
        store.write_bytes(spark, f"{out}/sig/manifest.hmac", hmac.new(key, body, "sha256").hexdigest().encode())
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        manifest = json.loads(store.read_bytes(spark, f"{path}/manifest.json"))
    except (Py4JJavaError, ValueError) as error:
        raise ShardError("MANIFEST", str(error).splitlines()[0]) from error
    if manifest.get("spec_version") != SPEC:
        raise ShardError("MANIFEST", f"spec_version is {manifest.get('spec_version')!r}")
    if not manifest.get("shard_id") or not (manifest.get("integrity") or {}).get("merkle_root"):
        raise ShardError("MANIFEST", "shard_id and integrity.merkle_root are mandatory")
    return manifest


def core_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    where = f"{path}/{PLACES[name]}/{name}.parquet"
    return spark.read.parquet(where) if store.exists(spark, where) else None


def extension_paths(spark: SparkSession, path: str) -> dict[str, str]:
    """name without version -> file, in order of file names."""
    return {schema.extension_name(n.removesuffix(".parquet"))[0]: f"{path}/ext/{n}" for n in store.names(spark, f"{path}/ext") if n.endswith(".parquet")}


def verify(spark: SparkSession, path: str, key: bytes | None = None) -> None:
    """Raises ShardError at the first rule that a shard breaks."""
    manifest = read_manifest(spark, path)
    strange = [n for n in store.names(spark, path) if n not in (*SEALED, "sig", "manifest.json") and n[0] not in "._"]
    if strange:
        raise ShardError("LAYOUT", f"{strange} do not belong to a shard")
    for name in PLACES:
        df = core_table(spark, path, name)
        if df is None:
            raise ShardError("LAYOUT", f"{name} is missing")
        missing = [c.split()[0] for c in schema.CORE[name].split(", ") if c.split()[0] not in df.columns]
        if missing:
            raise ShardError("SCHEMA", f"{name} has no {missing}")
        broken = validate.nulls(df, [c for c in df.columns if c in schema.KEYS[name]]).first()
        if broken:
            raise ShardError("NULL", f"{name}.{broken['column']}: {broken['n']}")
    claims, entities, provenance, spans = (core_table(spark, path, n) for n in ("claims", "entities", "provenance", "spans"))
    for table, column, parent, parent_key in ((provenance, "claim_id", claims, "claim_id"), (claims, "subject", entities, "entity_id")):
        if not validate.orphans(table, column, parent, parent_key).isEmpty():
            raise ShardError("ORPHAN", f"{column} without {parent_key}")
    if not store.exists(spark, f"{path}/content/sources.parquet"):
        raise ShardError("SOURCE", "content is missing")
    sources = spark.read.parquet(f"{path}/content/sources.parquet")
    changed = sources.where(F.sha2("text", 256) != F.col("source_hash")).first()
    if changed:
        raise ShardError("SOURCE", f"{changed['source_hash']} has another hash")
    bad = validate.span_bounds(spans, sources).first()
    if bad:
        raise ShardError("BOUNDS", f"{bad['reason']} {bad['source_hash']} {bad['byte_start']}..{bad['byte_end']}")
    texts = sources.select(F.unhex("source_hash").alias("_hash"), F.col("text").alias("_source"))
    # Bounds hold by now; a digest of what a span says meets its source in its place. Hashes are bytes here, half their digits.
    said = spans.select(F.unhex("source_hash").alias("_hash"), "byte_start", "byte_end", F.unhex(F.sha2("text", 256)).alias("_said"))
    cut = F.substr(F.col("_source").cast("binary"), F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int"))
    unlike = said.join(texts, "_hash").where(~F.coalesce(F.unhex(F.sha2(cut, 256)) == F.col("_said"), F.lit(False))).first()
    if unlike:
        at = (F.unhex("source_hash") == F.lit(unlike["_hash"])) & (F.col("byte_start") == unlike["byte_start"]) & (F.col("byte_end") == unlike["byte_end"])
        found = spans.where(at & (F.unhex(F.sha2("text", 256)) == F.lit(unlike["_said"]))).first()
        raise ShardError("BOUNDS", f"span {found['span_id']} is not what its source says")
    if root_of(spark, path) != manifest["integrity"]["merkle_root"]:
        raise ShardError("MERKLE", "the files do not give the manifest's root")
    if key:
        where = f"{path}/sig/manifest.hmac"
        want = hmac.new(key, store.read_bytes(spark, f"{path}/manifest.json"), "sha256").hexdigest()
        try:
            found = store.read_bytes(spark, where).decode(errors="replace")
        except Py4JJavaError:  # missing, or damaged below its checksum
            found = ""
        if not hmac.compare_digest(found.encode(), want.encode()):
            raise ShardError("SIGNATURE", "the manifest's signature does not hold")


def transport(spark: SparkSession, path: str) -> str:
    return "envelope" if store.exists(spark, f"{path}/envelope.json") else "shard" if store.exists(spark, f"{path}/manifest.json") else "unknown"


def store_listing(spark: SparkSession, root: str) -> DataFrame:
    """Shards of a store: name, shard_id, namespace, decision, modified; the latest first."""
    rows = []
    for name in store.names(spark, root):
        where = f"{root}/{name}/manifest.json"
        if store.exists(spark, where):
            m = json.loads(store.read_bytes(spark, where))
            rows.append((name, m.get("shard_id"), m.get("namespace"), (m.get("namespace") or "").startswith("decision"), store.modified(spark, where)))
    return spark.createDataFrame(rows, "name string, shard_id string, namespace string, decision boolean, modified double").orderBy(F.desc("modified"), "name")
