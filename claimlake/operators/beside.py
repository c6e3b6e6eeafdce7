"""Candidates beside the text of their document.

A document's candidates are dealt out in parts of bounded size, and its text goes once to each part; a part's rows are
held while its text is read, never a document's. What is looked for in a text are many strings at once: an Aho-Corasick
automaton is built of a part's strings and the text passes through it once, so the work is linear in the text, the strings
and their occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.runtime import written

#: Bytes of candidates (each counts ROW_BYTES and its strings) in a part.
PART_BYTES, ROW_BYTES = 2 << 20, 64
#: Parts of the candidates that have no document.
NO_ID = 1024

#: Up to so many different strings are looked for one by one.
FEW = 4

#: (text or None, a list for each used column) -> a list for each result.
Compute = Callable[..., tuple[list, ...]]


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Pieces of a partition sorted by ``keys`` that end where a key ends; a piece is about one batch, or one key's rows."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
        cut = next((i for i in range(len(at) - 1, 0, -1) if at[i] != at[i - 1]), 0)
        if held and at[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = at[-1]
    if held:
        yield pa.Table.from_batches(held)


def _met(batches: Iterator[pa.RecordBatch], use: list[str], compute: Compute, result: pa.Schema) -> Iterator[pa.RecordBatch]:
    for piece in whole_keys(batches, ["doc_id", "_part"]):
        at = list(zip(piece["doc_id"].to_pylist(), piece["_part"].to_pylist(), strict=True))
        text, is_text = piece["_text"].to_pylist(), piece["_is_text"].to_pylist()
        columns = [pc.struct_field(piece["_row"], c).to_pylist() for c in use]
        rows: list[int] = []
        found: list[list] = [[] for _ in result]
        i = 0
        while i < len(at):
            j = i
            while j < len(at) and at[j] == at[i]:
                j += 1
            first = next((k for k in range(i, j) if is_text[k]), j)  # candidates come before texts
            if first > i:
                values = [c[i:first] for c in columns]
                for words in text[first:j] or [None]:
                    for out, add in zip(found, compute(words, *values), strict=True):
                        out += add
                    rows += range(i, first)
            i = j
        if rows:
            picked = piece.select(["doc_id", "_row"]).take(rows).combine_chunks()
            arrays = [pa.array(v, f.type) for v, f in zip(found, result, strict=True)]
            yield from pa.Table.from_arrays([*picked.columns, *arrays], names=["doc_id", "_row", *result.names]).to_batches()


def beside_text(candidates: DataFrame, docs: DataFrame, use: list[str], result: list[tuple[str, str, pa.DataType]], compute: Compute, part_bytes: int = PART_BYTES) -> DataFrame:
    """``candidates`` (doc_id and others) with what ``compute`` finds of each in the text of its document: given a text and
    the columns ``use`` of a part's candidates, a list for each of ``result`` (name, SQL type, Arrow type). Candidates of
    unknown documents meet the text None; of several texts under one id each is met."""
    strings = [c for c, kind in candidates.dtypes if c in use and kind == "string"]
    weight = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(ROW_BYTES)).cast("long")
    sizes = candidates.where("doc_id is not null").groupBy("doc_id").agg(F.sum(weight).alias("_bytes")).where(F.col("_bytes") > part_bytes)
    large = written(sizes.select("doc_id", F.ceil(F.col("_bytes") / part_bytes).cast("int").alias("_parts")), "large")
    others = [c for c in candidates.columns if c != "doc_id"]
    row = candidates.select("doc_id", F.struct(*others).alias("_row"))
    texts = docs.where("doc_id is not null").select("doc_id", F.col("text").alias("_text"))
    apart = F.pmod(F.xxhash64("_row"), F.when(F.col("doc_id").isNull(), NO_ID))  # rows without an id meet no text anywhere
    if large.isEmpty():
        row, texts = row.withColumn("_part", F.coalesce(apart, F.lit(0)).cast("int")), texts.withColumn("_part", F.lit(0))
    else:  # Spark broadcasts a table as small as that, and knows its size
        row = row.join(large, "doc_id", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_row"), "_parts"), apart, F.lit(0)).cast("int")).drop("_parts")
        texts = texts.join(large, "doc_id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    both = row.withColumn("_is_text", F.lit(False)).unionByName(texts.withColumn("_is_text", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartition("doc_id", "_part").sortWithinPartitions("doc_id", "_part", "_is_text")
    kinds = dict(candidates.dtypes)
    schema = f"doc_id {kinds['doc_id']}, _row {row.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{n} {sql}" for n, sql, _ in result)
    arrow = pa.schema([(n, kind) for n, _, kind in result])
    met = dealt.mapInArrow(lambda batches: _met(batches, use, compute, arrow), schema)
    return met.select(*["doc_id" if c == "doc_id" else F.col(f"_row.{c}").alias(c) for c in candidates.columns], *[n for n, _, _ in result])


def found_in(text: str | None, needles: list[str | None]) -> tuple[list, list]:
    """For each string its occurrences without overlap, and 0, 1 or 2 (two or more) for its places, which may overlap. An empty
    string is nowhere; null, or any in no text, is not known."""
    if text is None:
        return [None] * len(needles), [None] * len(needles)
    distinct = {x for x in needles if x}
    if len(distinct) <= FEW:
        known: dict[str | None, tuple] = {"": (0, 0), None: (None, None)}
        for x in distinct:
            at = text.find(x)
            known[x] = (text.count(x), 0 if at < 0 else 1 if text.find(x, at + 1) < 0 else 2)
        return tuple([known[x][i] for x in needles] for i in (0, 1))
    automaton, slots, sizes = ahocorasick.Automaton(), {}, []
    for needle in needles:
        if needle and needle not in slots:
            slots[needle] = len(sizes)
            automaton.add_word(needle, len(sizes))
            sizes.append(len(needle))
    apart, places, last = [0] * len(sizes), [0] * len(sizes), [-1] * len(sizes)
    if sizes:
        automaton.make_automaton()
        for end, slot in automaton.iter(text):
            if places[slot] < 2:
                places[slot] += 1
            if end - sizes[slot] >= last[slot]:
                apart[slot] += 1
                last[slot] = end
    none = {"": 0, None: None}
    return tuple([none[x] if not x else counts[slots[x]] for x in needles] for counts in (apart, places))


def slices(text: str | None, starts: list[int | None], ends: list[int | None]) -> tuple[list]:
    """The bytes from each start to its end, null where they are outside or no text of their own."""
    if text is None:
        return ([None] * len(starts),)
    data = text.encode()

    def cut(a: int | None, b: int | None) -> str | None:
        if a is None or b is None or not 0 <= a <= b <= len(data):
            return None
        try:
            return data[a:b].decode()
        except UnicodeDecodeError:
            return None

    return ([cut(a, b) for a, b in zip(starts, ends, strict=True)],)


def exact(text: str | None, needles: list[str | None], starts: list[int | None], ends: list[int | None]) -> tuple[list]:
    """Whether each string, if not empty, is what lies at its bytes."""
    data = b"" if text is None else text.encode()
    return ([bool(x) and a is not None and b is not None and 0 <= a <= b <= len(data) and data[a:b] == x.encode() for x, a, b in zip(needles, starts, ends, strict=True)],)


def checked(text: str | None, needles: list[str | None], starts: list[int | None], ends: list[int | None]) -> tuple[list, list]:
    """What ``exact`` says, and the places of each string as ``found_in`` counts them (0 if not known)."""
    return *exact(text, needles, starts, ends), [n or 0 for n in found_in(text, needles)[1]]
