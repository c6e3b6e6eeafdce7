"""Pattern bundles: made from rules, signed, kept in a registry, tried in the shadow, spread to alike contexts."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.operators import adaptive, graph
from claimlake.sources.envelope import canonical

_TRIPLE = "struct<subject string, predicate string, object string>"
SCHEMA = (
    f"bundle_id string, domain string, scenario string, tags array<string>, source string, rules array<struct<condition {_TRIPLE}, action {_TRIPLE}>>, "
    "baseline double, improved double, metric string, samples long, entities array<string>, predicates array<string>, topology_hash string, status string, signature string, created double"
)


def create(spark: SparkSession, bundle: dict) -> dict:
    """Fills in what a bundle needs: sorted entities and predicates of its rules and the hash of their topology."""
    df = spark.createDataFrame([(bundle["bundle_id"], bundle["rules"])], f"bundle_id string, rules array<struct<condition {_TRIPLE}, action {_TRIPLE}>>")
    edges = adaptive.bundle_edges(df)
    need = adaptive.requirements(edges).first()
    out = {"source": None, "tags": [], "samples": 0, "metric": "accuracy", "status": "received", "signature": None, "created": time.time(), **bundle}
    out["entities"], out["predicates"] = (list(need["entities"]), list(need["predicates"])) if need else ([], [])
    out["topology_hash"] = graph.topology_hash(edges.select("subject", "predicate", "object")).first()["topology_hash"]
    return out


def _message(bundle: dict) -> bytes:
    return canonical({k: v for k, v in bundle.items() if k not in ("signature", "status")}).encode()


def new_keys(spark: SparkSession) -> tuple[str, str]:
    """A private and a public Ed25519 key, base64 of their standard encodings."""
    jvm = spark._jvm
    pair = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory = jvm.java.security.KeyFactory.getInstance("Ed25519")

    def encoded(key, spec: str) -> str:  # the key's own class is not open to reflection, its specification is
        return base64.b64encode(bytes(factory.getKeySpec(key, jvm.java.lang.Class.forName(f"java.security.spec.{spec}")).getEncoded())).decode()

    return encoded(pair.getPrivate(), "PKCS8EncodedKeySpec"), encoded(pair.getPublic(), "X509EncodedKeySpec")


def sign(spark: SparkSession, bundle: dict, private: str) -> dict:
    jvm = spark._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(base64.b64decode(private)))
    signer = jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(key)
    signer.update(_message(bundle))
    return {**bundle, "signature": base64.b64encode(bytes(signer.sign())).decode()}


def is_signed(spark: SparkSession, bundle: dict, public: str) -> bool:
    if not bundle.get("signature"):
        return False
    jvm = spark._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(base64.b64decode(public)))
    checker = jvm.java.security.Signature.getInstance("Ed25519")
    checker.initVerify(key)
    checker.update(_message(bundle))
    return bool(checker.verify(base64.b64decode(bundle["signature"])))


def save(bundles: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(b, sort_keys=True) + "\n" for b in sorted(bundles, key=lambda b: b["bundle_id"]))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def by_status(registry: DataFrame, status: str) -> DataFrame:
    return registry.where(F.col("status") == status)


def matching(registry: DataFrame, targets: DataFrame, least: float = adaptive.CONTEXT_AT_LEAST) -> DataFrame:
    """Bundles for each target, the best fit first."""
    return adaptive.context_fit(registry, targets, least).orderBy("target_id", F.desc("score"), "bundle_id")


def shadow(inputs: DataFrame, production: Callable[[DataFrame], DataFrame], candidate: Callable[[DataFrame], DataFrame], key: str, value: str) -> DataFrame:
    """Runs both on the same rows: key, production, shadow, improvement. Only what production says counts; the
    candidate's result is measured."""
    p = production(inputs).select(key, F.col(value).alias("production"))
    s = candidate(inputs).select(key, F.col(value).alias("shadow"))
    return p.join(s, key, "left").withColumn("improvement", F.coalesce(F.try_divide(F.col("shadow") - F.col("production"), F.col("production")), F.lit(0.0)))


class Controller:
    """The life of bundles on one node: received, tested in the shadow, adopted by a person or by itself, spread."""

    def __init__(self, spark: SparkSession, review: bool = True):
        self.spark, self.review = spark, review
        self.bundles: dict[str, dict] = {}
        self.samples: dict[str, list[float]] = {}

    def receive(self, bundle: dict, context_score: float) -> str:
        running = sum(b["status"] == "testing" for b in self.bundles.values())
        fit = "reject" if context_score < adaptive.CONTEXT_AT_LEAST else "adopt"
        bundle = {**bundle, "context_score": context_score, "status": adaptive.next_state("received", 0, fit, running)}
        self.bundles[bundle["bundle_id"]] = bundle
        return bundle["status"]

    def record(self, bundle_id: str, improvement: float) -> None:
        self.samples[bundle_id] = [*self.samples.get(bundle_id, []), improvement][-adaptive.RING :]

    def evaluate(self, bundle_id: str) -> str:
        b, seen = self.bundles[bundle_id], self.samples.get(bundle_id, [])
        frame = self.spark.createDataFrame([(bundle_id, float(b["context_score"]), float(b["baseline"]), float(b["improved"]))], "bundle_id string, context_score double, baseline double, improved double")
        shadows = self.spark.createDataFrame([(bundle_id, float(x)) for x in seen], "bundle_id string, improvement double")
        verdict = adaptive.evaluate(frame, shadows).first()["recommendation"]
        b["status"] = adaptive.next_state(b["status"], len(seen), verdict, 0, self.review)
        return b["status"]

    def approve(self, bundle_id: str) -> None:
        if self.bundles[bundle_id]["status"] != "human_review":
            raise ValueError("not under review")
        self.bundles[bundle_id]["status"] = "adopted"
