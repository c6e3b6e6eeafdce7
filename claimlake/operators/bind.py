"""From what a model said to byte-bound candidates: entity resolution, binding, merging, unambiguous evidence."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField
from pyspark.sql.window import Window

from claimlake.functions.scalar import ACRONYM, is_garbage_entity, object_type, occurrences
from claimlake.operators.asking import ask
from claimlake.operators.beside import beside_text, found_in, slices
from claimlake.operators.scan import ordered_scan
from claimlake.runtime import written


def acronyms(docs: DataFrame) -> DataFrame:
    """doc_id, acronym, full_name: the last definition of a document counts."""
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(ACRONYM), F.lit(2)).alias("acronym"), F.regexp_extract_all("text", F.lit(ACRONYM), F.lit(1)).alias("full_name"))
    found = docs.select("doc_id", F.posexplode(zipped).alias("k", "d")).select("doc_id", "k", F.col("d.acronym").alias("acronym"), F.col("d.full_name").alias("full_name"))
    return found.groupBy("doc_id", "acronym").agg(F.max_by("full_name", "k").alias("full_name"))


def canonical_forms(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """labels (doc_id, pos, label) -> doc_id, key, canonical: of a document's forms that differ by case only, the most
    frequent after acronyms are expanded; of equally frequent ones the one that got there first."""
    named = labels.withColumn("s", F.trim("label")).where("s <> ''").join(aliases.withColumnRenamed("acronym", "s"), ["doc_id", "s"], "left")
    dealt = named.select("doc_id", "pos", F.coalesce("full_name", "s").alias("form")).withColumn("key", F.lower("form")).repartition("doc_id", "key")
    forms = dealt.groupBy("doc_id", "key", "form").agg(F.count("*").alias("n"), F.max("pos").alias("reached"))  # where it was dealt, as is the next
    return forms.groupBy("doc_id", "key").agg(F.max_by("form", F.struct(F.col("n"), -F.col("reached"))).alias("canonical"))


def resolve(df: DataFrame, column: str, aliases: DataFrame, canonical: DataFrame, out: str) -> DataFrame:
    """Adds the canonical form of a label column in its document; blank becomes ``Unknown``."""
    a = aliases.select("doc_id", F.col("acronym").alias("_s"), F.col("full_name").alias("_full"))
    c = canonical.select("doc_id", F.col("key").alias("_key"), F.col("canonical").alias("_canonical"))
    df = df.withColumn("_s", F.trim(F.coalesce(F.col(column), F.lit(""))))
    df = df.join(a, ["doc_id", "_s"], "left").withColumn("_s", F.coalesce("_full", "_s")).withColumn("_key", F.lower("_s"))
    df = df.join(c, ["doc_id", "_key"], "left")
    label = F.when(F.col("_s") == "", "Unknown").otherwise(F.coalesce("_canonical", "_s"))
    return df.withColumn(out, label).drop("_s", "_full", "_key", "_canonical")


def _or(column: str, default: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), default)


def contiguous(ids: DataFrame, sentences: DataFrame) -> DataFrame:
    """ids (doc_id, pos, sentence_ids) -> doc_id, pos, first, last, page: runs of consecutive known sentences of one page."""
    known = sentences.select("doc_id", "index", "page")
    each = ids.select("doc_id", "pos", F.explode(F.array_distinct("sentence_ids")).alias("index")).join(known, ["doc_id", "index"])
    order = Window.partitionBy("doc_id", "pos").orderBy("index")
    fresh = ~((F.lag("index").over(order) + 1).eqNullSafe(F.col("index")) & F.lag("page").over(order).eqNullSafe(F.col("page")))
    runs = each.withColumn("island", F.sum(fresh.cast("int")).over(order))
    return runs.groupBy("doc_id", "pos", "island").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.min("page").alias("page")).drop("island")


def bound_spans(raw: DataFrame, sentences: DataFrame, source: DataFrame) -> DataFrame:
    """What ``bind`` gives, without the evidence: which claims stay, and where.

    Joins are of narrow rows; a claim's text, which is as long as the source, is joined to those that stay, once, and a digest
    of it tells claims apart before."""
    claims = raw.where("not coalesce(progress, false)")
    aliases = written(acronyms(source), "aliases")  # few as a rule: Spark knows how many, and sends them to the claims
    subjects = claims.select("doc_id", (2 * F.col("pos")).alias("pos"), F.col("subject").alias("label"))
    objects = claims.where(object_type(F.coalesce("object", F.lit(""))) == "entity").select("doc_id", (2 * F.col("pos") + 1).alias("pos"), F.col("object").alias("label"))
    canonical = canonical_forms(subjects.unionByName(objects), aliases)
    c = claims.withColumns({"claim_text": _or("claim_text", F.lit("Unknown")), "raw_subject": _or("subject", F.lit("Unknown")), "raw_predicate": _or("predicate", F.lit("relates to"))})
    c = c.select("doc_id", "pos", "raw_subject", F.lower("raw_predicate").alias("predicate"), _or("object", F.col("claim_text")).alias("raw_object"), F.unhex(F.sha2("claim_text", 256)).alias("_said"))
    c = resolve(resolve(c, "raw_subject", aliases, canonical, "s"), "raw_object", aliases, canonical, "o").withColumn("kind", object_type(F.col("raw_object")))
    c = c.withColumn("o", F.when(F.col("kind") == "entity", F.col("o")).otherwise(F.col("raw_object"))).where(~is_garbage_entity(F.col("s")))
    c = c.withColumn("kind", F.when((F.col("kind") == "entity") & is_garbage_entity(F.col("o")), "literal:string").otherwise(F.col("kind"))).drop("raw_subject", "raw_object")
    starts = sentences.select("doc_id", F.col("index").alias("first"), "byte_start")
    ends = sentences.select("doc_id", F.col("index").alias("last"), "byte_end")
    runs = contiguous(claims.select("doc_id", "pos", "sentence_ids"), sentences).join(starts, ["doc_id", "first"]).join(ends, ["doc_id", "last"])
    bound = c.join(runs, ["doc_id", "pos"])
    once = Window.partitionBy("doc_id", "_said", "byte_start", "byte_end").orderBy("pos")
    bound = bound.withColumn("k", F.row_number().over(once)).where("k = 1")
    return bound.select("doc_id", "pos", F.col("s").alias("subject"), "predicate", F.col("o").alias("object"), F.col("kind").alias("object_type"), F.lit(3).alias("tier"), "byte_start", "byte_end", F.col("page").alias("source_page"), "_said")


def bind(raw: DataFrame, sentences: DataFrame, source: DataFrame) -> DataFrame:
    """raw (doc_id, pos, claim_text, subject, predicate, object, sentence_ids, progress) over the documents' sentences
    (doc_id, index, byte_start, byte_end, page) and ``source`` (doc_id, text) -> byte-bound candidates, each document
    for itself.

    Progress rows and claims without a known sentence are skipped, claims about a vague subject too; a vague object is
    a literal. One candidate a run of sentences; the first of equal (claim, span) stays."""
    said = raw.where("not coalesce(progress, false)").select("doc_id", "pos", _or("claim_text", F.lit("Unknown")).alias("claim_text"))
    said = said.withColumn("_said", F.unhex(F.sha2("claim_text", 256))).dropDuplicates(["doc_id", "pos", "_said"])
    bound = bound_spans(raw, sentences, source).join(said, ["doc_id", "pos", "_said"]).drop("_said")
    return beside_text(bound, source, ["byte_start", "byte_end"], [("evidence", "string", pa.string())], slices)


def bind_report(raw: DataFrame, sentences: DataFrame, bound: DataFrame) -> DataFrame:
    """reason, n: why rows of ``raw`` gave no candidate, and how many did."""
    at = ["doc_id", "pos"]
    valid = raw.select(*at, F.explode("sentence_ids").alias("index")).join(sentences.select("doc_id", "index"), ["doc_id", "index"], "left_semi").select(*at).distinct().withColumn("valid", F.lit(True))
    done = bound.select(*at).distinct().withColumn("done", F.lit(True))
    reason = F.when(F.coalesce("progress", F.lit(False)), "progress").when(F.col("valid").isNull(), "no_valid_ids").when(F.col("done"), "emitted").otherwise("garbage_or_repeated")
    return raw.join(valid, at, "left").join(done, at, "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


#: Candidates that one task settles in order at the end.
LAST = 10_000


def greedy_merge(candidates: DataFrame, group: str = "doc_id", last: int = LAST) -> DataFrame:
    """In order of ``ordinal``, a candidate stays if neither its key (subject, predicate, object, 80 characters of
    evidence) nor its evidence has stayed before in its source; dropped ones register nothing.

    That is a greedy matching of keys with evidence. It is found by rounds over all sources at once: a candidate stays
    when it is the first of those left at its key and at its evidence, and takes from the rest what shares either with
    it; so each is settled once all earlier ones that share its key or evidence are. A round is two grouped minima and
    equi-joins of narrow rows; few rounds leave at most ``last`` candidates unless long chains of conflicts go up in order,
    and one task scans those. Of candidates with one key and one evidence only the first matters."""
    key = F.concat_ws("\x1f", "subject", "predicate", "object", F.left("evidence", F.lit(80)))
    named = lambda c: F.md5(F.concat_ws("\x1f", F.col(group).cast("string"), c).cast("binary"))
    first = candidates.groupBy(named(key).alias("_k"), named(F.col("evidence")).alias("_e"), group)
    first = written(first.agg(F.min_by(F.struct(*candidates.columns), "ordinal").alias("_row")), "first")
    left = first.select("_k", "_e", F.col(group).alias("_g"), F.col("_row.ordinal").alias("_o"))
    stays = []
    while True:
        order = F.struct("_o", "_k", "_e")  # of equal ordinals either goes first, always the same
        at_key, at_evidence = (left.groupBy(c).agg(F.min(order).alias(f"_first{c}")) for c in ("_k", "_e"))
        kept = left.join(at_key, "_k").join(at_evidence, "_e").where((F.col("_first_k") == order) & (F.col("_first_e") == order))
        kept = written(kept.select("_k", "_e"), "kept")
        stays.append(kept)
        left = written(left.join(kept.select("_k"), "_k", "left_anti").join(kept.select("_e"), "_e", "left_anti"), "left")
        if left.count() <= last:
            break

    def step(state: tuple[set, set], row: tuple) -> bool:
        fresh = row[0] not in state[0] and row[1] not in state[1]
        if fresh:
            state[0].add(row[0]), state[1].add(row[1])
        return fresh

    rest = ordered_scan(left, "_g", ["_o", "_k", "_e"], StructField("_stays", BooleanType()), lambda: (set(), set()), step)
    stays.append(rest.where("_stays").select("_k", "_e"))
    return first.join(reduce(DataFrame.union, stays), ["_k", "_e"], "left_semi").select("_row.*")


def unique_evidence(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds n_found; 1 is unambiguous, 0 is not in the source, more is ambiguous."""
    counts = [("n_found", "int", pa.int32()), ("_places", "int", pa.int32())]
    return beside_text(candidates, docs, ["evidence"], counts, found_in).drop("_places").where("n_found is not null")


def merge_candidates(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    return unique_evidence(greedy_merge(candidates), docs).where("n_found = 1").drop("n_found")


def parse_reply(reply: str) -> dict | None:
    """JSON of a model's reply; failing that, of what lies between its outer braces, if it has ``claims``."""
    try:
        return json.loads(reply)
    except ValueError:
        pass
    a, b = reply.find("{"), reply.rfind("}")
    if 0 <= a < b:
        try:
            found = json.loads(reply[a : b + 1])
            return found if isinstance(found, dict) and "claims" in found else None
        except ValueError:
            return None
    return None


def ask_report(said: DataFrame) -> DataFrame:
    """One row of counters over ``model_claims`` (a table: each read asks the model again): batches, claims, ids that are
    not of their batch, claims without any of it."""
    kept, strange = F.size("sentence_ids") > 0, F.size("ids_said") - F.size("sentence_ids")
    some = F.col("claim_text").isNotNull()
    return said.agg(
        F.countDistinct("doc_id", "batch_start").alias("batches"), F.count_if(some & kept).alias("claims"), F.coalesce(F.sum(F.when(some, strange)), F.lit(0)).cast("long").alias("dropped_hallucinated_ids"), F.count_if(some & ~kept).alias("dropped_no_valid_ids")
    )


def ask_model(prompts: DataFrame, model: Callable[[str], str], folder: str | None = None) -> DataFrame:
    """The claims of ``model_claims`` whose sentence ids lie, at least in part, in their batch."""
    return model_claims(prompts, model, folder).where("size(sentence_ids) > 0").drop("ids_said")


def model_claims(prompts: DataFrame, model: Callable[[str], str], folder: str | None = None) -> DataFrame:
    """prompts (doc_id, batch_start, ids array<int>, prompt) through an injected callable, Arrow batch by batch ->
    claim rows whose text is not blank, with the ids that were said and those of them that lie in the batch; a batch
    without claims is a row without text. With a ``folder`` answers are kept there (``asking.ask``): a prompt is asked once, over
    reads, lost executors and runs."""
    if folder is not None:
        replies = ask(prompts, model, folder)
        prompts = prompts.withColumn("prompt_key", F.sha2("prompt", 256)).join(replies, "prompt_key").drop("prompt_key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                reply = parse_reply(model(row.prompt) if folder is None else row.reply)
                claims = reply.get("claims", []) if isinstance(reply, dict) else []
                found = [c for c in claims if isinstance(c, dict) and (c.get("claim_text") or "").strip()]
                for c in found or [{}]:
                    said = [i for i in c.get("sentence_ids") or [] if isinstance(i, int)]
                    out.append((row.doc_id, row.batch_start, c.get("claim_text"), c.get("subject"), c.get("predicate"), c.get("object"), [i for i in said if i in set(row.ids)], said))
            yield pd.DataFrame(out, columns=["doc_id", "batch_start", "claim_text", "subject", "predicate", "object", "sentence_ids", "ids_said"])

    kind = prompts.schema["doc_id"].dataType.simpleString()
    return prompts.mapInPandas(run, f"doc_id {kind}, batch_start int, claim_text string, subject string, predicate string, object string, sentence_ids array<int>, ids_said array<int>")


def quote_claims(chunks: DataFrame, least: int = 50, most: int = 40) -> DataFrame:
    """The stand-in for a single-pass extractor: the first characters of a long enough chunk that holds no table, as a
    claim with the quote's place in it."""
    quote = F.trim(F.left(F.trim("text"), F.lit(most)))
    kept = chunks.where((F.length(F.trim("text")) >= least) & ~F.col("text").contains("<table")).withColumn("quote", quote)
    return kept.select("doc_id", "chunk_id", F.lit("document").alias("subject"), F.lit("states").alias("predicate"), F.col("quote").alias("object"), "quote", (F.call_function("locate", F.col("quote"), F.col("text")) - 1).alias("start"), occurrences(F.col("text"), F.col("quote")).alias("n_found"))
