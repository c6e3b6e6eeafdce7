"""Paragraphs, their structural roles, chunks, sentences and batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Patterns of roles, from the strongest to the weakest.
HEADING = r"^(#{1,4})\s+.+$|^\*\*[^*]{3,80}\*\*\s*$"
VERBATIM = r"(?i)(?:verbatim\s+statutory\s+text|statutory\s+text:|states\s+(?:in\s+)?(?:relevant\s+part|full)[:,])"
SANCTION = (
    r"(?i)\b(?:sanctions?|contempt|monetary\s+sanctions?|attorney.s?\s+fees?|set\s+aside\s+(?:the\s+)?judgment|harmless\s+error|penalties?|"
    r"consequences?\s+(?:for|of)\s+non-?compliance|violation\s+(?:of|results?\s+in)|failure\s+to\s+(?:comply|serve|file))\b"
)
DEADLINE = (
    r"(?i)\b(?:shall\s+(?:serve|file|submit|provide|exchange|disclose)|must\s+(?:be\s+filed|be\s+served|file|provide)|within\s+\d+\s+days?|mandatory\s+deadline|"
    r"triggering\s+event|no\s+later\s+than|prior\s+to\s+(?:filing|service)|upon\s+(?:filing|service|signing))\b"
)
AUTHORITY = r"(?i)(?:operative\s+(?:phase\s+\d+\s+)?authorities|governing\s+statute|applicable\s+(?:code|rule|statute)|controlling\s+authority)"
CASE = r"(?i)(?:In\s+re\s+Marriage\s+of\s+\w+|\w+\s+v\.?\s+\w+\s*\(\d{4}\)|\*[^*]{5,60}\*\s*\(\d{4}\))"
SECTION = r"(?i)(?:(?:California\s+)?(?:Family\s+Code|Fam\.?\s*Code|Evidence\s+Code|Code\s+of\s+Civil\s+Procedure|CCP|Penal\s+Code)\s*)?§+\s*\d+(?:\.\d+)?(?:\([a-zA-Z0-9]+\))*"
ALONE = ("HEADING", "VERBATIM", "SANCTION", "DEADLINE")
#: Words whose full stop ends no sentence.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "fig", "no", "inc", "ltd", "co", "corp", "al", "approx",
    "dept", "est", "cf", "vol", "pp",
)


def role(text: Column) -> Column:
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    full = F.filter(F.split(s, "\n", -1), lambda x: F.trim(x) != "")
    indented = F.filter(full, lambda x: x.startswith(">") | x.startswith("    ") | x.startswith("\t"))
    quoted = (F.size(indented) > 0) & (2 * F.size(indented) >= F.size(full))
    return (
        F.when(s.rlike("(?m)\\A(?:" + HEADING + ")"), "HEADING")
        .when(s.rlike(VERBATIM) | quoted, "VERBATIM")
        .when(s.rlike(SANCTION), "SANCTION")
        .when(s.rlike(DEADLINE), "DEADLINE")
        .when(s.rlike(AUTHORITY), "AUTHORITY")
        .when(s.rlike(CASE), "CASE")
        .when(s.rlike(SECTION), "SECTION")
        .otherwise("PROSE")
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, idx, text, byte_start, byte_end of the paragraphs between blank lines; offsets are exact bytes."""
    gap = r"\n\s*\n"
    parts = docs.select("doc_id", F.split("text", gap, -1).alias("p"), F.regexp_extract_all("text", F.lit(gap), F.lit(0)).alias("g"))
    flat = parts.select("doc_id", F.posexplode(F.arrays_zip("p", "g")).alias("i", "z"))
    flat = flat.select("doc_id", "i", F.col("z.p").alias("p"), (F.octet_length("z.p") + F.coalesce(F.octet_length("z.g"), F.lit(0))).cast("long").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flat = flat.withColumn("at", start)
    lead = F.octet_length(F.regexp_extract("p", r"^\s*", 0)).cast("long")
    text = F.regexp_replace("p", r"^\s+|\s+$", "")
    out = flat.select("doc_id", "i", text.alias("text"), (F.col("at") + lead).alias("byte_start")).where("text <> ''")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1
    return out.select("doc_id", idx.alias("idx"), "text", "byte_start", (F.col("byte_start") + F.octet_length("text")).alias("byte_end"))


def legal_chunks(docs: DataFrame, least: int = 40) -> DataFrame:
    """Consecutive paragraphs of one role are one chunk; ALONE roles are never merged; chunks under ``least``
    characters go, but for headings."""
    p = paragraphs(docs).withColumn("role", role(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("idx")
    fresh = F.col("role").isin(*ALONE) | ~F.col("role").eqNullSafe(F.lag("role").over(order))
    p = p.withColumn("island", F.sum(fresh.cast("int")).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    chunks = p.groupBy("doc_id", "island").agg(F.first("role").alias("role"), F.min("idx").alias("idx"), F.array_join(parts, "\n\n").alias("text"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"))
    kept = chunks.where((F.col("role") == "HEADING") | (F.length("text") >= least))
    chunk_id = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string"), F.lower("role"))
    return kept.select("doc_id", chunk_id.alias("chunk_id"), F.concat(F.lit("legal_"), F.lower("role")).alias("chunk_type"), "idx", "text", "byte_start", "byte_end")


def whole_chunks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.lit("prose").alias("chunk_type"), "text")


_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)|\n\s*\n")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of sentences, without the white space around them."""
    out, start = [], 0

    def add(a: int, b: int) -> None:
        part = text[a:b]
        if part.strip():
            out.append((a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())))

    for m in _END.finditer(text):
        word = re.search(r"([\w.]+)\.$", text[start : m.end()])
        if m[0].startswith(".") and word and (word[1].lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z]", word[1])):
            continue
        add(start, m.end())
        start = m.end()
    add(start, len(text))
    return out


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            at = size = 0
            for index, (a, b) in enumerate(sentence_spans(text or "")):
                start = size + len(text[at:a].encode())
                at, size = b, start + len(text[a:b].encode())
                rows.append((doc, index, text[a:b], start, size, 0))
        types = [batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "index", "text", "byte_start", "byte_end", "page"])


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, index, text, byte_start, byte_end, page: the slice of the document's bytes is the sentence."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_segment), f"doc_id {kind}, index int, text string, byte_start long, byte_end long, page int")


def batches(items: DataFrame, count: DataFrame, size: int = 20, overlap: int = 5) -> DataFrame:
    """Overlapping batches of indexed items: (doc_id, batch_start, index). ``count``: doc_id, n. Each item names its
    own batches, so no join on ranges is needed."""
    step = size - overlap
    last = F.floor(F.col("index") / step) * step
    first = F.greatest(F.lit(0), F.ceil((F.col("index") - size + 1) / step) * step)
    starts = F.sequence(first.cast("int"), last.cast("int"), F.lit(step))
    return items.join(count, "doc_id").where("index < n").select("doc_id", F.explode(starts).alias("batch_start"), "index")


def resume_cursor(progress: DataFrame, overlap: int = 5) -> DataFrame:
    """progress (last_sent_idx) -> the index to go on from."""
    return progress.agg(F.greatest(F.lit(0), F.coalesce(F.max("last_sent_idx") - overlap + 1, F.lit(0))).cast("long").alias("cursor"))
