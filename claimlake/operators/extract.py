"""Candidate claims from text and tables: tiers 0 and 1.

Inputs have ``doc_id`` and ``text``. Patterns are found with ``regexp_extract_all`` and lines by ``posexplode``, inside
one row's text; candidates are rows (doc_id, subject, predicate, object, object_type, evidence, tier,
extraction_method). A pattern's place is found again by splitting at its matches, so no Python worker is needed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.functions.scalar import DATE, MONEY, header_predicate
from claimlake.operators.beside import beside_text, found_in
from claimlake.operators.prefix import running
from claimlake.runtime import written

#: Running sums that are appended to one another before they are put away.
PART = 64
COLUMNS = ("doc_id", "subject", "predicate", "object", "object_type", "evidence", "tier", "extraction_method")
#: Patterns of statute sections, case citations, quotes, headings and references.
SECTION = r"(?i)(?:California\s+)?(?:Family\s+Code|Fam\.?\s*Code)\s*§\s*(\d+(?:\([a-z]\))?)"
CASE = r"\*([^*]{5,80})\*\s*\((\d{1,4}\s*Cal\.(?:App\.)?(?:3d|4th|5th|2d)?\s*\d+[^)]*)\)"
QUOTE = r"^>\s*(.+)$"
HEADING = r"^(#{1,4})\s+\**(.+?)\**\s*$"
UNDER = r"(?i)(?:under|pursuant\s+to|per|analyzed\s+under|referenced?\s+(?:in|by))\s+(?:(?:Family\s+Code|Fam\.?\s*Code)\s*)?§\s*(\d+)"
INTERPRETS = r"(?i)(?:\*([^*]+)\*|(?:In re Marriage of|Montenegro v\.|Burchard v\.)\s+(\w+))[^.]{0,100}§\s*(\d+)"
NODE = r"^NODE\s+(\d+):\s*(.+)$"


def _candidates(df: DataFrame, subject: Column, predicate: Column, obj: Column, evidence: Column, tier: int, method: str, object_type: str = "literal:string", *more: str) -> DataFrame:
    values = [F.col("doc_id"), subject, predicate, obj, F.lit(object_type), evidence, F.lit(tier), F.lit(method)]
    return df.select(*[v.alias(n) for v, n in zip(values, COLUMNS, strict=True)], *more)


def structured_lift(table: DataFrame, subject_col: str | None = None) -> DataFrame:
    """Each cell outside the first column becomes a claim about the first cell. Blank cells and rows are skipped."""
    subject_col = subject_col or table.columns[0]
    rest = [c for c in table.columns if c != subject_col]
    cells = table.select(F.col(subject_col).cast("string").alias("subject"), *[F.col(c).cast("string").alias(c) for c in rest]).unpivot("subject", rest, "predicate", "object")
    kept = cells.where("trim(object) <> '' and trim(subject) <> ''")
    evidence = F.concat_ws(": ", "predicate", "object")
    return kept.select("subject", "predicate", "object", F.lit("literal:string").alias("object_type"), evidence.alias("evidence"), F.lit(0).alias("tier"))


def sums(sizes: Column) -> Column:
    """The running sums of an array of longs. Appending copies an array, so they are gathered in short parts, and the parts in
    an array."""
    none, nested = F.array().cast("array<bigint>"), F.array().cast("array<array<bigint>>")

    def add(acc: Column, n: Column) -> Column:
        end = acc["end"] + n
        full = F.size(acc["part"]) >= PART
        return F.struct(end.alias("end"), F.array_append(F.when(full, none).otherwise(acc["part"]), end).alias("part"), F.when(full, F.array_append(acc["all"], acc["part"])).otherwise(acc["all"]).alias("all"))

    start = F.struct(F.lit(0).cast("long").alias("end"), none.alias("part"), nested.alias("all"))
    return F.aggregate(sizes, start, add, lambda acc: F.flatten(F.array_append(acc["all"], acc["part"])))


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, pos, line, byte_start, byte_end of every line, empty ones too, and the columns ``keep`` of its document.
    Offsets add up within the row's own array of lines, so nothing is shuffled."""
    split = docs.select("doc_id", *keep, F.split("text", "\n", -1).alias("ls"))
    ends = F.transform(sums(F.transform("ls", lambda x: F.octet_length(x).cast("long") + 1)), lambda x: x - 1)
    flat = split.withColumn("ends", ends).select("doc_id", *keep, F.posexplode(F.arrays_zip("ls", "ends")).alias("pos", "z"))
    return flat.select("doc_id", "pos", F.col("z.ls").alias("line"), (F.col("z.ends") - F.octet_length("z.ls")).alias("byte_start"), F.col("z.ends").alias("byte_end"), *keep)


def source_offsets(files: DataFrame) -> DataFrame:
    """files (path, text) -> path, byte_start, byte_end in their concatenation by path, each under a header line. Sizes add up
    by ranges of paths."""
    header = F.concat(F.lit("=== "), "path", F.lit(" ===\n"))
    sized = files.select("path", F.octet_length(header).cast("long").alias("h"), F.octet_length("text").cast("long").alias("n"))
    placed = running(sized.withColumn("size", F.col("h") + F.col("n") + 1), "size", ["path"])
    start = F.col("before") + F.col("h")
    return placed.select("path", start.alias("byte_start"), (start + F.col("n")).alias("byte_end"))


def matches(docs: DataFrame, pattern: str, *groups: int) -> DataFrame:
    """One row for each match: doc_id, text, k (from 0), g0 (the match), g<n>, at (character offset of the match)."""
    found = {f"_g{g}": F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (0, *groups)}
    df = docs.select("doc_id", "text").where(F.col("text").rlike(pattern)).withColumns(found)
    gaps = F.transform(F.split("text", pattern, -1), lambda x: F.length(x).cast("long"))  # what lies between the matches tells where they begin
    sizes = F.zip_with(gaps, F.concat(F.array(F.lit(0)), F.transform("_g0", lambda x: F.length(x))), lambda gap, match: gap + match)
    df = df.withColumn("_at", F.slice(F.transform(sums(sizes), lambda x: x.cast("int")), F.lit(1), F.size("_g0")))  # the last sum is behind all
    df = df.select("doc_id", "text", F.posexplode(F.arrays_zip(*found, "_at")).alias("k", "m"))
    return df.select("doc_id", "text", "k", *[F.col(f"m._g{g}").alias(f"g{g}") for g in (0, *groups)], F.col("m._at").alias("at"))


def sentence_around(text: Column, at: Column, size: Column, reach: int = 200) -> Column:
    """From after the last full stop before a match to the next one after it, or so many characters on."""
    ahead = F.substr(text, F.lit(1), at)
    start = F.length(F.substring_index(ahead, ".", -1))
    behind = F.substr(text, at + size + 1)
    dot = F.call_function("locate", F.lit("."), behind)
    until = F.when(dot > 0, dot).otherwise(F.least(F.length(behind), F.lit(reach)))
    return F.trim(F.regexp_replace(F.substr(text, at - start + 1, start + size + until), r"^\s+|\s+$", ""))


def statute_mentions(docs: DataFrame) -> DataFrame:
    found = matches(docs, SECTION, 1).withColumn("e", sentence_around(F.col("text"), F.col("at"), F.length("g0"))).where("length(e) >= 10")
    return _candidates(found, F.concat(F.lit("Family Code § "), "g1"), F.lit("referenced_in_context"), F.trim(F.left("e", F.lit(100))), F.col("e"), 0, "tier0_statutory_section")


def case_citations(docs: DataFrame) -> DataFrame:
    found = matches(docs, CASE, 1, 2)
    e = sentence_around(F.col("text"), F.col("at"), F.length("g0"))
    return _candidates(found, F.trim("g1"), F.lit("cited_as"), F.trim("g2"), e, 0, "tier0_case_citation")


def blockquotes(docs: DataFrame) -> DataFrame:
    quoted = lines(docs).withColumn("q", F.trim(F.regexp_extract("line", QUOTE, 1))).where("length(q) >= 30 and not (startswith(q, '**') and endswith(q, '**'))")
    return _candidates(quoted, F.lit("verbatim_holding"), F.lit("states"), F.left("q", F.lit(100)), F.col("q"), 0, "tier0_blockquote")


def _headings(docs: DataFrame) -> DataFrame:
    found = lines(docs).where(F.col("line").rlike(HEADING))
    found = found.withColumns({"level": F.length(F.regexp_extract("line", HEADING, 1)), "title": F.trim(F.regexp_extract("line", HEADING, 2))})
    node = F.when(F.col("title").rlike(NODE), F.trim(F.regexp_extract("title", NODE, 2)))
    return found.withColumn("node", F.last(node, True).over(Window.partitionBy("doc_id").orderBy("pos")))


def headings(docs: DataFrame) -> DataFrame:
    """Node headings cover a topic; deeper headings are analysed under the last node of their document."""
    h = _headings(docs)
    node = h.where(F.col("title").rlike(NODE))
    number = F.concat(F.lit("Node "), F.regexp_extract("title", NODE, 1))
    topics = _candidates(node, number, F.lit("covers_topic"), F.col("node"), F.trim("line"), 0, "tier0_heading_node")
    under = h.where(~F.col("title").rlike(NODE) & (F.col("level") >= 3) & F.col("node").isNotNull())
    return topics.unionByName(_candidates(under, F.col("title"), F.lit("analyzed_under"), F.col("node"), F.trim("line"), 0, "tier0_heading_structure"))


def cross_references(docs: DataFrame) -> DataFrame:
    """The nearest heading before a reference refers to the section; the first of equal triples of a document stays. A
    document's headings and references pass once in order of place; of a heading that goes on behind the reference only
    what is before it counts."""
    multi, of_doc = "(?m)" + HEADING, Window.partitionBy("doc_id")
    title = F.trim("g2")
    heads = matches(docs, multi, 2).select("doc_id", "at", F.struct(F.col("at").alias("start"), F.col("g0").alias("whole"), title.alias("title"), F.lag(title).over(of_doc.orderBy("at")).alias("before")).alias("head"))
    refs = matches(docs, UNDER, 1).select("doc_id", "at", F.struct("g1", sentence_around(F.col("text"), F.col("at"), F.length("g0")).alias("e")).alias("ref"))
    met = heads.unionByName(refs, allowMissingColumns=True).withColumn("head", F.last("head", True).over(of_doc.orderBy("at"))).where("ref is not null and head is not null")
    cut = F.substr(F.col("head.whole"), F.lit(1), F.col("at") - F.col("head.start"))
    ends = F.col("head.start") + F.length("head.whole") <= F.col("at")
    heading = F.when(ends, F.col("head.title")).when(cut.rlike(multi), F.trim(F.regexp_extract(cut, multi, 2))).otherwise(F.col("head.before"))
    found = met.select("doc_id", "at", heading.alias("heading"), "ref.g1", "ref.e").where("heading is not null")
    first = F.row_number().over(Window.partitionBy("doc_id", "heading", "g1").orderBy("at"))
    found = found.withColumn("first", first).where("first = 1")
    return _candidates(found, F.col("heading"), F.lit("references"), F.concat(F.lit("Family Code § "), "g1"), F.col("e"), 1, "tier1_crossref", "entity")


def case_interpretations(docs: DataFrame) -> DataFrame:
    found = matches(docs, INTERPRETS, 1, 2, 3)
    found = found.withColumns({"name": F.trim(F.coalesce(F.nullif("g1", F.lit("")), "g2")), "e": sentence_around(F.col("text"), F.col("at"), F.length("g0"))}).where("name <> ''")
    first = F.row_number().over(Window.partitionBy("doc_id", "name", "g3").orderBy("at"))
    found = found.withColumn("first", first).where("first = 1")
    return _candidates(found, F.col("name"), F.lit("interprets"), F.concat(F.lit("Family Code § "), "g3"), F.col("e"), 1, "tier1_case_interprets", "entity")


def markdown_tables(docs: DataFrame) -> DataFrame:
    """Cells of pipe tables: the first row that is no separator is the header; a line outside ends the table."""
    ls = lines(docs).withColumn("t", F.regexp_replace("line", r"^\s+|\s+$", ""))
    ls = ls.withColumn("row", F.col("t").rlike(r"^\|.*\|"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    ls = ls.withColumn("island", F.sum((~F.col("row")).cast("int")).over(order)).where("row")
    cells = F.transform(F.slice(F.split("t", r"\|", -1), F.lit(2), F.size(F.split("t", r"\|", -1)) - 2), lambda c: F.btrim(F.trim(c), F.lit("*")))
    ls = ls.withColumn("cells", cells).where(F.exists("cells", lambda c: ~c.rlike("^[-: ]*$")))
    island = Window.partitionBy("doc_id", "island").orderBy("pos")
    ls = ls.withColumns({"header": F.first("cells").over(island), "n": F.row_number().over(island)}).where("n > 1 and size(cells) >= 2 and trim(cells[0]) <> ''")
    cell = ls.select("doc_id", "t", "header", F.trim(F.col("cells")[0]).alias("s"), F.posexplode("cells").alias("i", "c")).where("i > 0 and trim(c) <> '' and i < size(header)")
    return _candidates(cell, F.col("s"), header_predicate(F.get("header", "i")), F.trim("c"), F.col("t"), 0, "tier0_markdown_table")


def mentions(chunks: DataFrame) -> DataFrame:
    """Tier 1: money and dates that prose chunks (doc_id, chunk_id, text) mention, in order."""
    out = []
    for kind, pattern in (("money", MONEY), ("date", DATE)):
        found = F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("k", "value")
        out.append(chunks.select("doc_id", "chunk_id", found).withColumn("predicate", F.lit(f"mentions_{kind}")))
    return out[0].unionByName(out[1])


def in_source(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates whose evidence occurs in their document. They are written first, since their sizes are asked for before they are
    dealt out and patterns cost more than a table."""
    candidates = written(candidates, "candidates")
    counts = [("_apart", "int", pa.int32()), ("_places", "int", pa.int32())]
    found = beside_text(candidates, docs, ["evidence"], counts, found_in)
    return found.where("_places > 0 or (evidence = '' and _places is not null)").drop("_apart", "_places")
