"""Packed token-id output.

Every document is encoded once, where it is read, and cut into whole rows and a rest; nothing is dropped. A whole row
is final. Rests are scattered by a seeded hash into blocks of about ``block_tokens`` tokens, so the rows do not depend
on how the table is partitioned, and each block is packed best-fit-decreasing: the fullest row that still has room is
found through a segment tree over remaining capacities. A packed row carries its id vector as little-endian 16- or
32-bit integers, the cumulative lengths of its segments and the position of each token within its segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import runs, table
from claimlake.llm.tokens import encode, load, vocabulary

CAPACITY, END, PAD = 2048, 50256, 50256
BLOCK_TOKENS = 2_000_000


class CapacityTree:
    """Segment tree over 0..capacity; a leaf is the stack of rows with that much room. ``take`` gives the row with
    the least room of at least ``n``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        at = n + self.leaves
        while not self.some[at]:
            while at & 1:  # a right child, or nothing to the right of the root
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            while at and not (at < self.leaves and (self.some[2 * at] or self.some[2 * at + 1])):
                self.some[at] = 0
                at >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; items longer first, equals in their order."""
    tree, rows = CapacityTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[item])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        rows[found[1]].append(item)
        tree.put(found[0] - lengths[item], found[1])
    return rows


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, dtype: str) -> Iterator[pa.RecordBatch]:
    encoder, _ = load(path)
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
            ids = np.append(encode(encoder, text.as_py() or ""), np.uint32(end)).astype(dtype)
            rows += [(doc, start, ids[start : start + capacity].tobytes()) for start in range(0, len(ids), capacity)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        types = (pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "ids"])


def _rows(part: list[list[tuple]], dtype: str, block: int | None, first: int) -> pa.RecordBatch:
    """``part``: rows of pieces (id, start, ids)."""
    sizes = [[len(p[2]) // np.dtype(dtype).itemsize for p in row] for row in part]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * len(part), pa.int64()),
            pa.array([None if block is None else first + k for k in range(len(part))], pa.int64()),
            pa.array([sum(s) for s in sizes], pa.int64()),
            pa.array([[p[0] for p in row] for row in part], pa.list_(pa.int64())),
            pa.array([[p[1] for p in row] for row in part], pa.list_(pa.int64())),
            pa.array([np.concatenate([[0], np.cumsum(s)]) for s in sizes], pa.list_(pa.int32())),
            pa.array([b"".join(p[2] for p in row) for row in part], pa.binary()),
            pa.array([np.concatenate([np.arange(n) for n in s]).astype(dtype).tobytes() for s in sizes], pa.binary()),
        ],
        names=["block", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"],
    )


def _whole(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _rows([[p] for p in zip(*(batch[c].to_pylist() for c in ("id", "start", "ids")), strict=True)], dtype, None, 0)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rests, sorted by block and within it in an order of their own."""
    for part in runs(batches, ["block"]):
        blocks = part["block"].to_numpy()
        cut = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(blocks)], strict=True):
            one = part.slice(a, b - a)
            pieces = list(zip(*(one[c].to_pylist() for c in ("id", "start", "ids")), strict=True))
            rows = best_fit_decreasing([len(p[2]) // np.dtype(dtype).itemsize for p in pieces], capacity)
            for k in range(0, len(rows), 512):
                yield _rows([[pieces[i] for i in row] for row in rows[k : k + 512]], dtype, int(blocks[a]), k)


def packed_ids(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = END, block_tokens: int = BLOCK_TOKENS, path: str | None = None, wide: bool = False
) -> DataFrame:
    """-> one row per packed row: block, row, n_tokens, doc_ids and starts (of its segments: the document and the
    offset of the piece in it), cu_seqlens (from 0), input_ids and position_ids (binary; ``wide``: 32 bits).

    Each document's ids are followed by ``end``; null counts as empty, so it is the one id ``end``. Only documents
    longer than ``capacity`` are cut; a piece that fills a row is that row, in no block (block and row null). The rows
    are a function of the table's rows, however they are partitioned; equal rests under one id share a block. Rows
    repeated under one id are packed each for itself. A null id stays null. An empty table gives no rows; other
    columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dtype = "<u4" if wide else "<u2"
    cut = rows.mapInArrow(partial(_pieces, path=path or vocabulary(), capacity=capacity, end=end, dtype=dtype), "id long, start long, ids binary")
    pieces = table(cut, "pieces")
    full = F.octet_length("ids") == capacity * np.dtype(dtype).itemsize
    total = pieces.where(~full).agg(F.sum(F.octet_length("ids").cast("long"))).first()[0] or 0
    blocks = max(1, -(-(total // np.dtype(dtype).itemsize) // block_tokens))
    key = F.xxhash64(F.lit(23), "id", "ids")
    rests = pieces.where(~full).withColumns({"block": F.pmod(key, F.lit(blocks)), "h": key})
    rests = rests.repartition("block").sortWithinPartitions("block", "h", "id", "start", "ids").drop("h")
    schema = "block long, row long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
    whole = pieces.where(full).mapInArrow(partial(_whole, dtype=dtype), schema)
    return whole.union(rests.mapInArrow(partial(_pack, capacity=capacity, dtype=dtype), schema))


def write(packed: DataFrame, path: str, *, capacity: int = CAPACITY, pad: int = PAD, wide: bool = False) -> None:
    """Parquet with the id matrix: ``input_ids`` filled up with ``pad`` to equal width; ``n_tokens`` tells where it
    begins. No rows, no files but an empty one; other columns are written as they are."""
    width = 4 if wide else 2
    filler = F.unhex(F.lit(pad.to_bytes(width, "little").hex()))
    missing = F.expr(f"{capacity} - n_tokens").cast("int")
    matrix = F.concat("input_ids", F.unhex(F.repeat(F.hex(filler), missing)))
    packed.withColumn("input_ids", matrix).write.parquet(path)
