"""Encrypted envelopes: files of a shard under one key per colour, bound to the topology of its graph.

AES-GCM runs in Spark (``aes_encrypt`` and ``aes_decrypt`` over binaryFile rows), and files are written by the tasks that have
them (``whole_files``); the driver derives keys and holds the header. Folders must be where all executors reach them.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.scalar import classification
from claimlake.operators.graph import edges, topology_hash
from claimlake.runtime import delete, scratch
from claimlake.schema import COLOURS
from claimlake.sources import store
from claimlake.sources.shards import ShardError
from claimlake.sources.whole_files import safe, write_files


def hkdf(secret: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    """HMAC-based key derivation (RFC 5869) with SHA-256."""
    key, out, block = hmac.new(salt or bytes(32), secret, "sha256").digest(), b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(key, block + info + bytes([i]), "sha256").digest()
        out += block
    return out[:length]


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def from_base64(text: str) -> bytes:
    """Strict but for missing padding."""
    return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)


def _topology(spark: SparkSession, path: str) -> str:
    return topology_hash(edges(spark.read.parquet(f"{path}/graph/claims.parquet"))).first()["topology_hash"]


def _part(name: str) -> str:
    """The folder of a file that is sealed and opened at once, where those of a shard go in turn: a table's, or the file itself."""
    return "/".join(name.split("/")[:2])


def _put(files: DataFrame, target: str, what: str, add: bool = False) -> None:
    """files (path, content, problem) below ``target``; the first path by name with a problem raises, and then nothing is left."""
    seen = Observation(f"put_{uuid.uuid4().hex}")
    files = files.observe(seen, F.min(F.when(F.col("content").isNull(), F.struct("path", "problem"))).alias("first"))
    write_files(files.select("path", "content"), target, add=add)
    if (first := seen.get["first"]) is not None:
        raise ShardError("MERKLE", f"{what} {first['path']}: {first['problem']}")


def _blobs(spark: SparkSession, path: str, entries: DataFrame, hashes: list[str] | None = None) -> DataFrame:
    """entries (name, hash, ...) with the blob of that hash, read where the task is; a missing one raises. Entries, which
    the header on the driver holds, go to the blobs, so no blob is shuffled. ``hashes``: those
    of all entries, so that no other blob is read."""
    there = None if hashes is None else [f"{path}/blobs/{h}" for h in sorted({*hashes} & {*store.names(spark, f"{path}/blobs")})]
    blobs = spark.read.format("binaryFile").load(there or f"{path}/blobs").select(F.element_at(F.split("path", "/"), -1).alias("hash"), F.col("content").alias("blob"))
    gone = entries.join(blobs.select("hash"), "hash", "left_anti").agg(F.min("name")).first()[0]
    if gone is not None:
        raise ShardError("MERKLE", f"{gone}: its blob is missing")
    return blobs.join(F.broadcast(entries), "hash")


def seal(spark: SparkSession, path: str, out: str, secret: bytes, colour_of: dict[str, str] | None = None, default: str = "Green", consume: bool = False) -> dict:
    """Encrypts every file of a shard, manifest and signature too. ``colour_of``: path prefix -> colour. Files are read,
    encrypted and written in one pass of tasks; the header is written last and holds names and hashes alone.

    A nonce is a digest of the file's name: keys are new with every salt and names differ, so none comes twice under a key, and
    a task that runs again writes the same blob. ``consume``: tables are sealed in turn and each is removed when its blobs are written,
    so a shard is never there twice; for a shard that can be made again, as a failure leaves a part of it."""
    colour_of = colour_of or {}
    bad = {c for c in [*colour_of.values(), default] if c not in COLOURS}
    if bad:
        raise ShardError("LAYOUT", f"no such colours: {sorted(bad)}")
    root, topology = store.qualified(spark, path).rstrip("/"), _topology(spark, path)
    salt = os.urandom(16)
    parts = [""]
    if consume:
        tops = [n for n in store.names(spark, path) if n[0] not in "._"]
        parts = [p for top in tops for p in ([top] if store.is_file(spark, f"{path}/{top}") else [f"{top}/{n}" for n in store.names(spark, f"{path}/{top}")])]
    entries = []
    for i, part in enumerate(parts):
        blobs = _sealed(spark, root, part, secret, salt, topology, colour_of, default)
        listing = f"{scratch(spark)}/listing"
        write_files(blobs, f"{out}/blobs", listing, add=i > 0)
        entries += [json.loads(json.loads(line)) for line in store.read_bytes(spark, listing).decode().splitlines()]
        if consume:
            delete(spark, f"{path}/{part}")
    listed = sorted(entries, key=lambda f: f["path"])
    head = {"version": "2.0", "topology_hash": topology, "salt": base64.b64encode(salt).decode(), "files": listed, "files_digest": hashlib.sha256(canonical(listed).encode()).hexdigest()}
    head["mac"] = hmac.new(hkdf(secret, salt, b"header"), canonical(head).encode(), "sha256").hexdigest()
    store.write_bytes(spark, f"{out}/envelope.json", canonical(head).encode())
    return head


def _sealed(spark: SparkSession, root: str, part: str, secret: bytes, salt: bytes, topology: str, colour_of: dict[str, str], default: str) -> DataFrame:
    """The blobs (path, content) of a shard's files below ``part``, each with its entry in the header as note."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{part}".rstrip("/"))
    files = files.select(F.substring("path", len(root) + 2, 1 << 30).alias("name"), "content")
    chosen = F.coalesce(*[F.when(F.col("name").startswith(p), c) for p, c in sorted(colour_of.items(), key=lambda x: -len(x[0]))], F.lit(default))
    key = F.coalesce(*[F.when(F.col("colour") == c, F.lit(hkdf(secret, salt, f"{c}:{topology}".encode()))) for c in COLOURS])
    nonce = F.substring(F.unhex(F.sha2(F.concat(F.lit("nonce:"), "name"), 256)), 1, 12)
    sealed = F.aes_encrypt(F.col("content"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.concat_ws(":", "colour", "name"))
    files = files.withColumn("colour", chosen).withColumn("sealed", sealed)
    note = F.struct(F.col("name").alias("path"), "colour", classification(F.col("colour")).alias("classification"), F.sha2("content", 256).alias("plain_hash"), F.sha2("sealed", 256).alias("blob"))
    return files.withColumn("entry", note).select(F.col("entry.blob").alias("path"), F.col("sealed").alias("content"), F.to_json("entry").alias("note"))


def _open_first(spark: SparkSession, path: str, head: dict, version: str, secret: bytes, into: str) -> str:
    """Envelopes of versions 1.0 and 1.1: one key, a nonce for each file, and the file's place and hash (1.1: of its plain
    text, 1.0: of its blob) as authenticated data. Blobs are read, checked and decrypted where they are read."""
    if version not in ("1.0", "1.1"):
        raise ShardError("MANIFEST", f"envelope version {version!r}")
    kdf, files = head.get("kdf") or {}, head.get("files")
    if head.get("encryption_algo") != "AES-256-GCM" or kdf.get("name") != "HKDF-SHA256":
        raise ShardError("MANIFEST", "encryption or key derivation is not supported")
    if not head.get("envelope_id") or not head.get("shard_id") or not isinstance(files, list) or not files:
        raise ShardError("MANIFEST", "envelope_id, shard_id and files are mandatory")
    plain_json = lambda value: json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if head.get("files_digest_sha256_b64"):
        kept = [{k: str(f[k]) for k in ("path", "blob_hash", "nonce_b64", "plaintext_hash") if k != "plaintext_hash" or f.get(k)} for f in files]
        digest = hashlib.sha256(plain_json(sorted(kept, key=lambda f: f["path"].encode())).encode()).digest()
        if digest != base64.b64decode(head["files_digest_sha256_b64"], validate=True):
            raise ShardError("MERKLE", "files digest")
    rows = []
    for f in files:
        if not all(f.get(k) for k in ("path", "blob_hash", "nonce_b64")) or not safe(f["path"]):
            raise ShardError("LAYOUT", f"unsafe or incomplete entry {f.get('path')}")
        bound = "plaintext_hash" if f.get("plaintext_hash") else "blob_hash"
        aad = plain_json({"envelope_id": head["envelope_id"], "shard_id": head["shard_id"], "path": f["path"], bound: f[bound]})
        rows.append((f["path"], f["blob_hash"], f.get("plaintext_hash") or None, bytearray(base64.b64decode(f["nonce_b64"], validate=True)), aad))
    key = hkdf(secret, base64.b64decode(kdf.get("salt_b64", ""), validate=True), str(kdf.get("info", "")).encode())
    entries = spark.createDataFrame(rows, "name string, hash string, plain string, nonce binary, aad string")
    content = F.try_aes_decrypt(F.concat("nonce", "blob"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.col("aad").cast("binary"))
    found = _blobs(spark, path, entries).withColumn("content", F.when(F.sha2("blob", 256) == F.col("hash"), content))
    right = F.col("plain").isNull() | (F.sha2("content", 256) == F.col("plain"))
    target = f"{into.rstrip('/')}/{hashlib.sha256(str(head['envelope_id']).encode()).hexdigest()[:16]}"
    _put(found.select(F.col("name").alias("path"), F.when(right, F.col("content")).alias("content"), F.lit("the blob is changed, or the secret is wrong").alias("problem")), target, "file")
    return target


def open_envelope(spark: SparkSession, path: str, secret: bytes, into: str, colours: tuple[str, ...] = COLOURS, consume: bool = False) -> str:
    """Checks and decrypts; returns the shard's folder. Wrong secret, changed header, blobs, names or topology raise. ``consume``:
    tables are opened in turn and the blobs of each removed when they are, so a failure leaves neither (version 2.0 only)."""
    head = json.loads(store.read_bytes(spark, f"{path}/envelope.json"))
    other = next((str(v) for k, v in head.items() if k.endswith("_version")), None)
    if other is not None and "version" not in head:
        return _open_first(spark, path, head, other, secret, into)
    mac, salt = head.pop("mac", ""), from_base64(head["salt"])
    if head.get("version") != "2.0":
        raise ShardError("MANIFEST", f"envelope version {head.get('version')!r}")
    if not hmac.compare_digest(mac, hmac.new(hkdf(secret, salt, b"header"), canonical(head).encode(), "sha256").hexdigest()):
        raise ShardError("SIGNATURE", "header or secret is wrong")
    if hashlib.sha256(canonical(head["files"]).encode()).hexdigest() != head["files_digest"]:
        raise ShardError("MERKLE", "files digest")
    target = f"{into.rstrip('/')}/{head['topology_hash'][:16]}"
    wanted = [f for f in head["files"] if f["colour"] in colours]
    rows = []
    for f in wanted:
        if not safe(f["path"]):
            raise ShardError("LAYOUT", f"unsafe path {f['path']}")
        rows.append((f["path"], f["colour"], f["plain_hash"], f["blob"], bytearray(hkdf(secret, salt, f"{f['colour']}:{head['topology_hash']}".encode()))))
    parts = sorted({_part(r[0]) for r in rows}) if consume else [None]
    if consume:
        delete(spark, target)
    for part in parts:
        own = [r for r in rows if part in (None, _part(r[0]))]
        try:
            _open(spark, path, own, target, consume)
        except Exception:
            if consume:
                delete(spark, target)
            raise
        for r in own if consume else []:
            delete(spark, f"{path}/blobs/{r[3]}")
    if set(colours) == set(COLOURS) and _topology(spark, target) != head["topology_hash"]:
        delete(spark, target)
        raise ShardError("MERKLE", "the graph is not the one that the keys are bound to")
    return target


def _open(spark: SparkSession, path: str, rows: list[tuple], target: str, add: bool) -> None:
    """Decrypts the files of ``rows`` (name, colour, hash of the plain file, hash of the blob, key) below ``target``."""
    df = spark.createDataFrame(rows, "name string, colour string, plain string, hash string, key binary")
    whole = F.sha2("blob", 256) == F.col("hash")
    plain = F.try_aes_decrypt(F.col("blob"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws(":", "colour", "name").cast("binary"))
    df = _blobs(spark, path, df, [r[3] for r in rows] if add else None).withColumn("content", F.when(whole, plain))
    problem = F.when(~whole, "the blob was changed").otherwise("the content is not what was sealed")
    right = F.sha2("content", 256) == F.col("plain")
    _put(df.select(F.col("name").alias("path"), F.when(right, F.col("content")).alias("content"), problem.alias("problem")), target, "file", add)


def keep_secret(spark: SparkSession, secret: str, password: str, rounds: int = 600_000) -> str:
    """A secret under a password, as text: AES-GCM under a PBKDF2-SHA256 key."""
    salt = os.urandom(16)
    key = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)
    row = spark.range(1).select(F.aes_encrypt(F.lit(secret).cast("binary"), F.lit(key), F.lit("GCM")).alias("c")).first()
    return base64.b64encode(salt + bytes(row["c"])).decode()


def recall_secret(spark: SparkSession, kept: str, password: str, rounds: int = 600_000) -> str:
    raw = base64.b64decode(kept)
    key = hashlib.pbkdf2_hmac("sha256", password.encode(), raw[:16], rounds, 32)
    row = spark.range(1).select(F.try_aes_decrypt(F.lit(raw[16:]), F.lit(key), F.lit("GCM")).cast("string").alias("s")).first()
    if row["s"] is None:
        raise ValueError("wrong password")
    return row["s"]
