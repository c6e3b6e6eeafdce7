"""Mounting shards as views, and asking them."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import sqlite3
import threading
import time
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake import schema
from claimlake.functions import ids
from claimlake.functions.scalar import sanitize_identifier
from claimlake.operators import constraints, nlq, resolve, vector
from claimlake.plans import gate
from claimlake.runtime import scratch
from claimlake.sources import envelope, shards, store

NAMESPACE = uuid.UUID("6f1c1c7e-0f5a-4a51-9a5e-3f6f0f6f7a10")


#: Rows of an answer that are sent to the caller at once.
ANSWER_ROWS = 10_000


def answer_of(df: DataFrame, most: int = ANSWER_ROWS) -> dict:
    """Columns and the first ``most`` rows; ``truncated`` where there are more."""
    rows = [list(r) for r in df.limit(most + 1).collect()]
    return {"columns": df.columns, "rows": rows[:most], **({"truncated": True} if len(rows) > most else {})}


@dataclass(frozen=True)
class Mount:
    mount_id: str
    shard_id: str
    merkle_root: str
    spec_version: str
    source_path: str
    transport: str
    tables: dict[str, str] = field(default_factory=dict)

    @property
    def mount_prefix(self) -> str:
        return self.mount_id.replace("-", "")[:12]


class Session:
    """One set of mounts. Views: ``<table>__<prefix>__<shard>`` for each mount, and a union view for every table;
    core tables and known extensions always exist, empty if nothing is mounted."""

    def __init__(self, spark: SparkSession, catalog: str | None = None, audit: str | None = None, key: bytes | None = None, verify: bool = True):
        self.spark, self.audit, self.key, self.verify = spark, audit, key, verify
        self.mounts: dict[str, Mount] = {}
        self._frames: dict[str, dict[str, DataFrame]] = {}
        self._known: set[str] = set()
        self._lock = threading.RLock()
        self._catalog = catalog
        self._vectors: DataFrame | None = None
        self._embed: vector.Embedder = vector.hashed
        if catalog:
            with self._db() as db:
                db.execute("create table if not exists mounts (mount_id text primary key, source_path text, auto_mount int, status text, detail text)")
                db.execute("create table if not exists system_events (ts real, event text, detail text)")
        ids.register(spark)
        self._unions()

    @classmethod
    def from_environment(cls, spark: SparkSession, environ: Mapping[str, str] = os.environ) -> Session:
        """CLAIMLAKE_CATALOG and CLAIMLAKE_AUDIT are files, CLAIMLAKE_KEY the base64 of the key that manifests are sealed
        with, CLAIMLAKE_VERIFY=0 mounts unchecked; what is not set is as in the constructor."""
        key = environ.get("CLAIMLAKE_KEY")
        return cls(spark, environ.get("CLAIMLAKE_CATALOG"), environ.get("CLAIMLAKE_AUDIT"), base64.b64decode(key, validate=True) if key else None, environ.get("CLAIMLAKE_VERIFY", "1") != "0")

    # --- catalog -------------------------------------------------------------------------------------------------
    def _db(self) -> sqlite3.Connection:
        db = sqlite3.connect(self._catalog, timeout=5)
        db.execute("pragma journal_mode=wal")
        return db

    def _record(self, mount_id: str, path: str, status: str, detail: str = "") -> None:
        if self._catalog:
            with self._db() as db:
                db.execute(
                    "insert into mounts values (?, ?, 1, ?, ?) on conflict (mount_id) do update set source_path = excluded.source_path, status = excluded.status, detail = excluded.detail", (mount_id, path, status, detail)
                )
                db.execute("insert into system_events values (?, ?, ?)", (time.time(), status, mount_id))

    def _write_audit(self, event: dict) -> None:
        if self.audit:
            Path(self.audit).parent.mkdir(parents=True, exist_ok=True)
            with open(self.audit, "a") as f:
                f.write(json.dumps({"ts": time.time(), **event}, sort_keys=True) + "\n")

    # --- mounts --------------------------------------------------------------------------------------------------
    def mount(self, path: str, secret: bytes | None = None, into: str | None = None) -> Mount:
        """Mounts a shard, or an envelope after opening it below ``into``. Mounting twice is mounting once."""
        kind, origin = shards.transport(self.spark, path), path
        if kind == "envelope":
            if secret is None or into is None:
                raise shards.ShardError("LAYOUT", "an envelope needs a secret and a folder to open it in")
            path = envelope.open_envelope(self.spark, path, secret, into)
        elif kind == "unknown":
            raise shards.ShardError("LAYOUT", f"{path} is neither a shard nor an envelope")
        manifest = shards.read_manifest(self.spark, path)
        root = manifest["integrity"]["merkle_root"]
        mount_id = str(uuid.uuid5(NAMESPACE, json.dumps({"merkle_root": root, "shard_id": manifest["shard_id"]}, sort_keys=True)))
        with self._lock:
            if mount_id in self.mounts:
                return self.mounts[mount_id]
            try:
                if self.verify:
                    shards.verify(self.spark, path, self.key)
                frames = {n: df for n in shards.PLACES if (df := shards.core_table(self.spark, path, n)) is not None}
                if "claims" not in frames:
                    raise shards.ShardError("LAYOUT", "claims are missing")
                frames |= {n: self.spark.read.parquet(p) for n, p in shards.extension_paths(self.spark, path).items()}
            except shards.ShardError as error:
                self._record(mount_id, origin, "failed", str(error))
                raise
            mount = Mount(mount_id, manifest["shard_id"], root, manifest["spec_version"], origin, kind)
            for name, df in frames.items():
                stamped = df.withColumn("mount_id", F.lit(mount_id))
                if name != "lineage":
                    stamped = stamped.withColumn("shard_id", F.lit(manifest["shard_id"]))
                prefix = name if name in shards.PLACES else f"ext_{name}"
                view = f"{prefix}__{mount.mount_prefix}__{sanitize_identifier(manifest['shard_id'])}"
                stamped.createOrReplaceTempView(f"`{view}`")
                mount.tables[name] = view
                frames[name] = stamped
            self.mounts[mount_id], self._frames[mount_id] = mount, frames
            self._unions()
            self._record(mount_id, origin, "mounted")
            self._write_audit({"event": "mount", "mount_id": mount_id, "shard_id": mount.shard_id})
            return mount

    def unmount(self, mount_id: str) -> None:
        with self._lock:
            mount = self.mounts.pop(mount_id, None)
            if mount is None:
                return
            self._frames.pop(mount_id)
            for view in mount.tables.values():
                self.spark.catalog.dropTempView(view)
            self._unions()
            self._record(mount_id, mount.source_path, "stopped")

    def _unions(self) -> None:
        names = {*schema.CORE, *schema.EXTENSIONS, *(n for f in self._frames.values() for n in f)}
        for gone in self._known - names:
            self.spark.catalog.dropTempView(gone)
        self._known = names
        for name in names:
            self.table(name).createOrReplaceTempView(f"`{name}`")
            if name in schema.ALIASES:
                self.table(name).createOrReplaceTempView(schema.ALIASES[name])
        self.resolved().createOrReplaceTempView("claims_resolved")

    def table(self, name: str) -> DataFrame:
        """All mounts' rows of a table; columns are matched by name, missing ones are null."""
        order = sorted(self._frames, key=lambda m: (self.mounts[m].shard_id, m))
        own = [self._frames[m][name] for m in order if name in self._frames[m]]
        if name in {**schema.CORE, **schema.EXTENSIONS}:
            own = own or [schema.empty(self.spark, name)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)

    def resolved(self) -> DataFrame:
        return resolve.claims_resolved(self.table("claims"), self.table("entities"))

    def boot(self) -> dict:
        """Mounts again what the catalog knows and no one stopped."""
        out = {"attempted": 0, "mounted": 0, "failed": 0}
        if self._catalog:
            with self._db() as db:
                rows = db.execute("select source_path from mounts where auto_mount = 1 and status <> 'stopped' order by mount_id").fetchall()
            for (path,) in rows:
                out["attempted"] += 1
                try:
                    self.mount(path)
                    out["mounted"] += 1
                except (shards.ShardError, OSError):
                    out["failed"] += 1
        return out

    def catalog_json(self) -> list[dict]:
        return [{**asdict(m), "mount_prefix": m.mount_prefix} for m in sorted(self.mounts.values(), key=lambda m: (m.shard_id, m.mount_id))]

    def health(self) -> dict:
        return {"status": "ok", "mounts": len(self.mounts), "views": sorted(self._known)}

    # --- queries ---------------------------------------------------------------------------------------------------
    def sql(self, query: str) -> DataFrame:
        gate.check(self.spark, query)
        return self.spark.sql(query)

    def query_json(self, query: str, most: int = ANSWER_ROWS) -> dict:
        began = time.time()
        answer = answer_of(self.sql(query), most)
        self._write_audit({"event": "query", "sql_hash": hashlib.sha256(query.encode()).hexdigest()[:16], "row_count": len(answer["rows"]), "elapsed_ms": round(1000 * (time.time() - began)), "active_mounts": len(self.mounts)})
        return answer

    def ask(self, question: str, limit: int = nlq.LIMIT) -> DataFrame:
        return nlq.ask(question, self.resolved(), self.table("temporal"), self.table("lineage"), limit)

    def index(self, embed: vector.Embedder = vector.hashed, mount_id: str | None = None) -> dict:
        """Vectors of the claims of one mount or all, by an injected embedder, as a table for ``search``. A claim that the
        index has is not embedded again, unless the embedder changes."""
        claims = self.resolved().select("mount_id", "claim_id", F.concat_ws(" ", "subject", "predicate", "object").alias("text"))
        claims = claims.where(F.col("mount_id") == mount_id) if mount_id else claims
        if self._vectors is not None and self._embed is embed:
            claims = claims.join(self._vectors, ["mount_id", "claim_id"], "left_anti")
        path = f"{scratch(self.spark)}/vectors"
        vector.embedded(claims, embed).write.parquet(path)
        fresh = self.spark.read.parquet(path)
        self._vectors = self._vectors.unionByName(fresh) if self._vectors is not None and self._embed is embed else fresh
        self._embed = embed
        self._write_audit({"event": "index", "mount_id": mount_id})
        return {"status": "ok", "indexed": fresh.count(), "index_size": self._vectors.count()}

    def search(self, question: str, k: int = 7) -> DataFrame:
        """mount_id, claim_id, text and score of the ``k`` claims nearest to the question."""
        if self._vectors is None:
            raise ValueError("nothing is indexed")
        q = self._embed([question])[0]
        score = F.round(vector.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 5)
        return self._vectors.select("mount_id", "claim_id", "text", score.alias("score")).orderBy(F.desc_nulls_last("score"), "claim_id", "mount_id").limit(k)

    def colour_views(self, folder: str) -> list[str]:
        """A view ``claims_<colour>`` for each <colour>.jsonl of a folder of opened partitions."""
        named = [c.lower() for c in schema.COLOURS if store.exists(self.spark, f"{folder}/{c.lower()}.jsonl")]
        for colour in named:
            self.spark.read.json(f"{folder}/{colour}.jsonl").createOrReplaceTempView(f"claims_{colour}")
        return [f"claims_{colour}" for colour in named]

    def evaluate(self, requests: DataFrame, **options) -> DataFrame:
        return constraints.decide(requests, self.resolved(), **options)

    def provenance(self) -> DataFrame:
        return resolve.provenance_chain(self.table("claims"), self.table("entities"), self.table("provenance"), self.table("spans"), self.table("locators"))


class Chat:
    """Questions in turn; the last ``most`` are remembered."""

    def __init__(self, session: Session, most: int = 20):
        self.session, self.most, self.history = session, most, []

    def ask(self, question: str) -> dict:
        answer = {"question": question, **answer_of(self.session.ask(question))}
        self.history = [*self.history, answer][-self.most :]
        return answer
