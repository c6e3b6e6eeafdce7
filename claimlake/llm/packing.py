"""Best-fit packing by exact-complement hashing.

Pieces are known to the planner by length only, and lengths do not exceed the capacity, so a plan over counts has a
fixed size for any corpus. From the longest length down, a piece's gap is looked up in an index of single lengths, sums of two
and sums of three that loses an entry when its counts run out; a combination that fills the gap exactly is used as
often as the counts allow. Where none exists, the longest piece that fits goes in (best fit) and the search repeats
on the rest of the gap. The plan says for each length which ranks go to which sequences at which offset; a piece's
rank among those of its length comes from salted windows, so no length or group of copies is one task's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.llm.common import table
from claimlake.llm.tokens import encode, load, vocabulary

CAPACITY, END = 1024, 2
#: Pieces of one length that one window ranks, on average.
RANK_BLOCK = 1_000


class Complements:
    """An index from a gap to what fills it exactly: the available lengths themselves, pairs under their sum and triples
    under theirs (as one length and the sum of the other two, which is a key of the pairs). An entry leaves the index
    when a count that it needs runs out; counts only fall, so each leaves once. Where the three of a triple include
    equal lengths its counts are looked at when it is found."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        self.free = counts
        self.pairs = np.zeros((n, (n + 1) // 2), bool)  # [sum, the smaller length]
        some = np.flatnonzero(counts)
        for a in some[2 * some < n].tolist():
            partner = some[(some >= a) & (some < n - a)]
            self.pairs[a + partner, a] = True
            self.pairs[2 * a, a] = counts[a] > 1
        self.n_pairs = self.pairs.sum(1)
        self.triples = np.zeros((n, n), bool)  # [sum, one of the lengths]
        for a in some.tolist():
            self.triples[a + np.flatnonzero(self.n_pairs[: n - a]), a] = True

    def take(self, length: int, number: int = 1) -> None:
        before = self.free[length]
        self.free[length] = now = before - number
        if now <= 1 < before and 2 * length < len(self.free):
            self._leave(np.array([2 * length]), np.array([length]))
        if now == 0:
            partner = np.arange(1, len(self.free) - length)
            self._leave(partner + length, np.minimum(partner, length))
            self.triples[:, length] = False

    def _leave(self, sums: np.ndarray, smaller: np.ndarray) -> None:
        held = self.pairs[sums, smaller]
        self.pairs[sums[held], smaller[held]] = False
        self.n_pairs[sums[held]] -= 1
        for gone in sums[held][self.n_pairs[sums[held]] == 0].tolist():  # no triple has this sum for its pair any more
            a = np.arange(len(self.free) - gone)
            self.triples[a + gone, a] = False

    def fill(self, gap: int) -> list[int] | None:
        if self.free[gap] > 0:
            return [gap]
        if self.n_pairs[gap]:
            return self._pair(gap)
        longest = np.flatnonzero(self.triples[gap])
        for a in longest[longest >= -(-gap // 3)][::-1].tolist():
            pair = self._pair(gap - a, a)
            if pair:
                return [a, *pair]
        return None

    def _pair(self, gap: int, most: int | None = None) -> list[int] | None:
        """The pair with the largest smaller count; with ``most`` beside a piece of that length, neither longer."""
        low = np.flatnonzero(self.pairs[gap])
        low = low[gap - low <= most] if most else low
        if not len(low):
            return None
        high = gap - low
        counts = [self.free[x] - (x == most) for x in (low, high)]
        both = np.where(low == high, counts[0] // 2, np.minimum(*counts))
        best = int(both.argmax())
        return [int(high[best]), int(low[best])] if both[best] > 0 else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset): ``number`` pieces of ``length``, from ``first
    rank`` on, go to consecutive sequences at ``offset``. Sorted by length and rank."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    used, sequence, slots = np.zeros(capacity + 1, np.int64), 0, []
    index = Complements(free)
    for longest in range(capacity, 0, -1):
        while free[longest] > 0:
            row, gap = [longest], capacity - longest
            index.take(longest)
            while gap:
                exact = index.fill(gap)
                if exact is None:
                    fits = np.flatnonzero(free[: gap + 1])
                    if not len(fits):
                        break
                    exact = [int(fits[-1])]
                for length in exact:
                    index.take(length)
                    gap -= length
                row += exact
            need = np.bincount(row, minlength=capacity + 1)
            where = np.flatnonzero(need)
            times = 1 + int((free[where] // need[where]).min())
            if times > 1:
                for length in where.tolist():
                    index.take(length, int(need[length]) * (times - 1))
            offset = 0
            for length in row:
                slots.append((length, used[length], times, sequence, offset))
                used[length] += times
                offset += length
            sequence += times
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    encoder, widths = load(path)
    dtype = "<u2" if max(len(widths) - 1, end) < 1 << 16 else "<u4"  # on the way; results have 32 bits
    tail = np.array([end], np.uint32)
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
            ids = np.concatenate([encode(encoder, text.as_py() or ""), tail])
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), ids[a:b].astype(dtype).tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())], names=["id", "piece", "start", "length", "ids_crc32", "ids"])


def _assign(batches: Iterator[pa.RecordBatch], slots: np.ndarray, key: int) -> Iterator[pa.RecordBatch]:
    where = slots[:, 0] * key + slots[:, 1]
    for batch in batches:
        columns = {c: batch[c].to_numpy() for c in ("length", "rank")}
        at = np.searchsorted(where, columns["length"] * key + columns["rank"], "right") - 1
        held = zip(batch["ids"].to_pylist(), columns["length"].tolist(), strict=True)
        ids = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in held]
        out = [*[batch[c] for c in ("id", "piece", "start", "length")], pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
        names = ["id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([*out, pa.array(slots[at, 3] + columns["rank"] - slots[at, 1]), pa.array(slots[at, 4])], names=names)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """-> one row per piece: id, piece, start, length, ids (binary: little-endian, 32 bits), ids_crc32 (of these bytes),
    sequence_id, offset.

    A document is its ids and ``end``; null counts as empty, so it is the one id ``end``. Only documents longer than
    ``capacity`` are cut; all pieces but the first have full length. Rows repeated under one id give their pieces
    each for itself, equal ones in any order; a null id stays null. Texts of any length are taken whole.
    Which of equally long pieces lies in which of the places planned for that length is decided by their ranks, and changes
    no count of sequences. An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, piece long, start long, length long, ids_crc32 long, ids binary"
    pieces = table(rows.mapInArrow(partial(_pieces, path=path or vocabulary(), capacity=capacity, end=end), schema), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = plan(counts, capacity)
    # A length has as many salts as its count asks for, so pairs of both stay in proportion to the pieces.
    salts = F.element_at(F.array(*[F.lit(-(-counts.get(n, 1) // RANK_BLOCK)) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), salts))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "start", "ids")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(bases.select("length", "salt", "base"), ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids", (F.col("base") + F.col("own") - 1).alias("rank"))
    key = max(counts.values(), default=0) + 1
    schema = "id long, piece long, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long"
    out = ranked.mapInArrow(partial(_assign, slots=slots, key=key), schema)
    return out.withColumn("piece", F.col("piece").cast("int")).withColumnRenamed("id", id_col)
