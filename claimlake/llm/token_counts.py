"""Token counts by offset-mapped attribution.

The fields of a row are joined to one document and encoded once. Token spans in characters are then interval-joined
to the spans of the sections (both are sorted, so one search serves all tokens of a document). A token that crosses a
boundary goes, by ``rule``, to the section of its first character (``first``) or to the one that holds most of its
characters, the earlier of equals (``most``). The counts of a document's sections add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm.tokens import encode, load, vocabulary

RULES = ("first", "most")


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token [start, end), and whether it crosses into a later one. ``sections``: their starts; the
    first starts at 0 and each lasts to the next. An empty token lies where it starts."""
    if rule not in RULES:
        raise ValueError(rule)
    own = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, np.maximum(ends - 1, starts), "right") - 1
    crossing = last > own
    if rule == "most":
        edges = np.append(sections, np.iinfo(np.int64).max)
        for t in np.flatnonzero(crossing):
            candidates = np.arange(own[t], last[t] + 1)
            held = np.minimum(edges[candidates + 1], ends[t]) - np.maximum(edges[candidates], starts[t])
            own[t] = candidates[held.argmax()]
    return own, crossing


def _spans(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens from their byte lengths. A character split over tokens belongs to the span of the
    token that has its first byte."""
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ends = np.cumsum(lengths)
    return characters[ends - lengths], characters[ends]


def _count(batches: Iterator[pa.RecordBatch], path: str, by: str, rule: str) -> Iterator[pa.RecordBatch]:
    encoder, widths = load(path)
    for batch in batches:
        rows: list[tuple] = []
        for doc, fields in zip(batch["id"], batch["fields"].to_pylist(), strict=True):
            text = "\n".join(f or "" for f in fields)
            raw = np.frombuffer(text.encode(), np.uint8)
            ids = encode(encoder, text)
            starts, ends = _spans(raw, widths[ids])
            if by == "lines":
                character = np.cumsum((raw & 0xC0) != 0x80)
                sections = np.concatenate([[0], character[raw == 0x0A]])
            else:
                sections = np.concatenate([[0], np.cumsum([len(f or "") + 1 for f in fields])[:-1]])
            own, crossing = attribute(starts, ends, sections, rule)
            n = np.bincount(own, minlength=len(sections))
            across = np.bincount(own[crossing], minlength=len(sections))
            until = np.append(sections[1:], len(text))
            rows += [(doc.as_py(), k, *r) for k, r in enumerate(zip(sections.tolist(), until.tolist(), n.tolist(), across.tolist(), strict=True))]
            if len(rows) > 100_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), *, by: str = "lines", rule: str = "first", path: str | None = None) -> DataFrame:
    """-> one row per section: id, section (from 0), char_start, char_end, n_tokens, n_crossing.

    ``fields`` are text columns, joined by a newline; ``by`` cuts the whole at every line or at the fields. A
    section ends with the newline that cuts it off. Null counts as empty; an empty document is one empty section. Rows
    repeated under one id are counted each for itself; a null id stays null. An empty table gives no rows. Texts of any
    length are encoded whole. A token that two sections share in equal parts goes to the first by rule ``most`` too. Columns
    other than the id and ``fields`` are not looked at.
    """
    if by not in ("lines", "fields") or rule not in RULES:
        raise ValueError((by, rule))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.array(*[F.col(f) for f in fields]).alias("fields"))
    schema = "id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"
    return rows.mapInArrow(partial(_count, path=path or vocabulary(), by=by, rule=rule), schema).withColumnRenamed("id", id_col)
