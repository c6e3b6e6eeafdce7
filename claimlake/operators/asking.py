"""Calls with effects, such as a model's: asked a few at a time, kept as they are answered, not asked again.

Answers lie in a folder that all executors reach, under the SHA-256 of their prompt: a table ``answers`` and, of a run that goes
on or was cut short, ``pieces`` by the first digits of the key. A task looks into the pieces of its keys before it asks, and the
next run asks only what is left, so a lost executor costs at most ``every`` calls of each of its tasks. Runs on one folder
go one after another, and without speculative tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.scalar import occurrences
from claimlake.runtime import delete, ready
from claimlake.sources import store
from claimlake.sources.whole_files import place

ANSWER = "prompt_key string, reply string"
#: Digits of a key that name its folder of pieces.
DIGITS = 3


class Unanswered(Exception):
    """Some prompts failed at every try; the answers of all others are kept."""


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """prompt_key, reply: every answer that is kept, one for a prompt."""
    found = spark.createDataFrame([], ANSWER)
    if store.exists(spark, f"{folder}/answers"):
        found = found.unionByName(spark.read.schema(ANSWER).parquet(f"{folder}/answers"))
    if store.exists(spark, f"{folder}/pieces"):
        found = found.unionByName(spark.read.schema(ANSWER).option("recursiveFileLookup", "true").json(f"{folder}/pieces"))
    return found.groupBy("prompt_key").agg(F.min("reply").alias("reply"))


def _kept(system: arrow_fs.FileSystem, folder: str) -> set[str]:
    """Keys that an earlier attempt has answered."""
    pieces = system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    keys = set()
    for piece in pieces:
        if piece.base_name.endswith(".json"):
            with system.open_input_stream(piece.path) as stream:
                keys.update(json.loads(line)["prompt_key"] for line in stream.read().decode().splitlines())
    return keys


def _keep(system: arrow_fs.FileSystem, folder: str, found: list[tuple[str, str]]) -> None:
    name = uuid.uuid4().hex
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/.{name}") as stream:
        stream.write("".join(json.dumps({"prompt_key": k, "reply": r}) + "\n" for k, r in found).encode())
    system.move(f"{folder}/.{name}", f"{folder}/{name}.json")


def ask(prompts: DataFrame, model: Callable[[str], str], folder: str, *, parallel: int = 4, every: int = 16, tries: int = 3, tasks: int | None = None) -> DataFrame:
    """prompts (prompt) -> prompt_key, reply of each distinct prompt that is not null, kept in ``folder``.

    ``parallel`` calls run at once in a task and ``tasks`` (Spark's number of shuffle partitions) tasks share the prompts; each
    ``every`` answers are kept as they come. A call that raises is tried ``tries`` times; if some prompt fails then, Unanswered is raised
    after all others have been asked, and the next run asks only those again."""
    spark = ready(prompts.sparkSession)
    key = F.sha2("prompt", 256)
    asked = prompts.where("prompt is not null").select(key.alias("prompt_key"), "prompt").dropDuplicates(["prompt_key"])
    missing = asked.join(answers(spark, folder), "prompt_key", "left_anti").withColumn("bucket", F.left("prompt_key", F.lit(DIGITS)))
    dealt = (missing.repartition(tasks, "bucket") if tasks else missing.repartition("bucket")).sortWithinPartitions("bucket")

    def call(prompt: str) -> tuple[str | None, str | None]:
        for k in range(tries):
            try:
                return model(prompt), None
            except Exception as e:  # whatever a caller's function raises
                problem = f"{type(e).__name__}: {e}"
        return None, problem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(f"{folder}/pieces")
        known: tuple[str, set[str]] = ("", set())
        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                n, failed = 0, []
                for bucket, rows in groupby(zip(*(batch[c].to_pylist() for c in ("bucket", "prompt_key", "prompt")), strict=True), lambda r: r[0]):
                    if known[0] != bucket:
                        known = (bucket, _kept(system, f"{root}/{bucket}"))
                    left = [r for r in rows if r[1] not in known[1]]
                    for i in range(0, len(left), every):
                        part = left[i : i + every]
                        said = list(zip(part, pool.map(call, [r[2] for r in part]), strict=True))
                        good = [(r[1], reply) for r, (reply, _) in said if reply is not None]
                        failed += [problem or "no reply" for _, (reply, problem) in said if reply is None]
                        n += len(good)
                        if good:
                            _keep(system, f"{root}/{bucket}", good)
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "failed": pa.array([len(failed)], pa.int64()), "problem": pa.array([min(failed, default=None)], pa.string())})

    done = dealt.mapInArrow(run, "n long, failed long, problem string").agg(F.sum("failed").alias("failed"), F.min("problem").alias("problem")).first()
    if store.exists(spark, f"{folder}/pieces"):  # the table first: what is in both is one answer
        spark.read.schema(ANSWER).option("recursiveFileLookup", "true").json(f"{folder}/pieces").write.mode("append").parquet(f"{folder}/answers")
        delete(spark, f"{folder}/pieces")
    if done["failed"]:
        raise Unanswered(f"{done['failed']} prompts failed, the first with {done['problem']}")
    return answers(spark, folder).join(asked.select("prompt_key"), "prompt_key", "left_semi")


#: A reply is a JSON list of these.
CLAIMS = "array<struct<subject:string,predicate:string,object:string,value:string,quote:string,confidence:double>>"


def extracted(chunks: DataFrame, model: Callable[[str], str], folder: str, prompt: str = "{content}", least: int = 50, **options) -> DataFrame:
    """chunks (doc_id, chunk_id, text and, if there is one, chunk_type) through a model in one pass -> doc_id, chunk_id, subject, predicate,
    object, value, confidence, quote, start, end, n_found of each claim whose quote lies in its chunk.

    Tables and chunks of fewer than ``least`` characters are not asked about. ``prompt`` takes the text in place of
    ``{content}``. A reply is a JSON list, or an object with such a list as ``claims``; of one that is neither, or is no JSON, there are no claims. A quote is taken without
    white space at its ends, its place is the first, and a claim whose quote is empty or not in the chunk to the letter is dropped. Equal chunks are asked about once."""
    kept = chunks.where(F.length("text") >= least)
    if "chunk_type" in chunks.columns:
        kept = kept.where("not (chunk_type <=> 'table')")
    said = kept.select("doc_id", "chunk_id", "text", F.replace(F.lit(prompt), F.lit("{content}"), F.col("text")).alias("prompt")).withColumn("prompt_key", F.sha2("prompt", 256))
    reply = ask(said, model, folder, **options)
    claims = F.when(F.ltrim("reply").startswith("{"), F.from_json("reply", f"claims {CLAIMS}")["claims"]).otherwise(F.from_json("reply", CLAIMS))
    each = said.drop("prompt").join(reply, "prompt_key").withColumn("c", F.explode(F.filter(claims, lambda c: c.isNotNull())))
    named = [F.trim(F.coalesce(F.col(f"c.{name}"), F.lit(other))).alias(name) for name, other in (("subject", "unknown"), ("predicate", "related_to"), ("object", "unknown"))]
    found = each.select("doc_id", "chunk_id", "text", *named, "c.value", F.coalesce("c.confidence", F.lit(0.5)).alias("confidence"), F.regexp_replace("c.quote", r"(?U)^\s+|\s+\z", "").alias("quote"))
    start = F.call_function("locate", F.col("quote"), F.col("text")) - 1
    found = found.where((F.length("quote") > 0) & F.col("text").contains(F.col("quote"))).withColumn("start", start)
    return found.select("doc_id", "chunk_id", "subject", "predicate", "object", "value", "confidence", "quote", "start", (F.col("start") + F.length("quote")).alias("end"), occurrences(F.col("text"), F.col("quote")).alias("n_found"))
