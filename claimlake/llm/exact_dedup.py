"""Exact duplicates by owners in compressed radix (Patricia) tries.

Rows are dealt by (length, content hash), so equal texts meet, and a task sorts its rows by length and bytes. It inserts
whole byte strings, under their length, into a compressed radix trie in which texts share their common beginnings; a
terminal node holds the owner's id and the number of rows. As keys arrive in byte order, everything to the left of the
path of the last key is complete: when the trie outgrows its budget those subtrees are spilled to the output, one by
one, and only the path stays. A trie runs first on each input partition as a combiner, so that a text with a third of
all rows crosses the shuffle once per task. Owners go back to the rows by length and SHA-256; those of large groups are
broadcast, so the rows of a frequent text are not gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import table, text_bytes

#: Bytes of text that one trie holds before its complete subtrees are spilled.
BUDGET = 32 << 20
#: Owners of groups of more rows than this are broadcast; the bound rises with the rows so that no more than MOST_LARGE
#: groups can have so many.
LARGE, MOST_LARGE = 1000, 100_000


class Node:
    """``label`` is the compressed edge into the node; a terminal node has ``count`` > 0."""

    __slots__ = ("children", "count", "label", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.count = label, {}, None, 0

    def add(self, owner: int | None, count: int, largest: bool) -> None:
        if owner is not None and (self.owner is None or (owner > self.owner if largest else owner < self.owner)):
            self.owner = owner
        self.count += count


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Byte strings with their owners. ``held`` counts the bytes of its labels."""

    def __init__(self, largest: bool):
        self.root, self.largest, self.held = Node(b""), largest, 0

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(key) - at + 200
                node = child
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            split = _common(label, key[at : at + len(label)])
            fork = node.children[key[at]] = Node(label[:split])
            child.label = label[split:]
            fork.children[child.label[0]] = child
            self.held += 200
            node, at = fork, at + split
        node.add(owner, count, self.largest)

    def spill(self, last: bytes | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """(key, owner, count) of subtree by subtree, in byte order; each is freed as it is given. With ``last``, the
        largest key so far, the nodes of its path stay: keys to come may end in them or below."""
        if last is None:
            root, self.root, self.held = self.root, Node(b""), 0
            yield from self._subtree(b"", root)
            return
        node, at = self.root, 0
        while at < len(last):
            for c in sorted(c for c in node.children if c != last[at]):
                child = node.children.pop(c)
                yield from self._subtree(last[:at], child, freed=True)
            node = node.children[last[at]]
            at += len(node.label)

    def _subtree(self, prefix: bytes, node: Node, freed: bool = False) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(prefix, node)]
        while stack:
            prefix, node = stack.pop()
            prefix += node.label
            if freed:
                self.held -= len(node.label) + 200
            if node.count:
                yield prefix, node.owner, node.count
            stack += [(prefix, node.children[c]) for c in sorted(node.children, reverse=True)]
            node.children = {}


def _combine(batches: Iterator[pa.RecordBatch], largest: bool, budget: int) -> Iterator[pa.RecordBatch]:
    """A partition in any order -> its texts once each (more often where the budget cuts it), with owner and count."""
    trie = PatriciaTrie(largest)

    def spilled() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in trie.spill():
            rows.append(row)
            size += len(row[0])
            if size > 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    for batch in batches:
        for owner, text in zip(batch["id"].to_pylist(), batch["b"], strict=True):
            trie.insert(text.as_py(), owner)
            if trie.held > budget:
                yield from spilled()
    yield from spilled()


def _batch(rows: list[tuple[bytes, int | None, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["b", "owner", "n"]
    )


def _own(batches: Iterator[pa.RecordBatch], largest: bool, budget: int) -> Iterator[pa.RecordBatch]:
    """A partition sorted by length and text -> one row for each different text."""
    trie, last = PatriciaTrie(largest), b""

    def rows_of(spilled: Iterator[tuple[bytes, int | None, int]]) -> Iterator[pa.RecordBatch]:
        rows = [(len(k) - 8, hashlib.sha256(memoryview(k)[8:]).hexdigest(), owner, n) for k, owner, n in spilled]
        if rows:
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["size", "sha", "owner", "n"])

    for batch in batches:
        for size, text, owner, n in zip(*(batch[c].to_pylist() for c in ("size", "b", "owner", "n")), strict=True):
            last = size.to_bytes(8, "big") + text
            trie.insert(last, owner, n)
            if trie.held > budget + len(last):
                yield from rows_of(trie.spill(last))
    yield from rows_of(trie.spill())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", budget: int = BUDGET) -> DataFrame:
    """-> one row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty; texts of any length are held whole. The owner is the
    smallest (or largest) non-null id of equal texts; without one keep_id is null. ``kept`` is true on the rows that
    carry the owner's id and, where there is no owner, on every row; rows repeated under one id and text stand or fall
    together. An empty table gives no rows; other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    options = {"largest": keep == "largest", "budget": budget}
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("b"))
    local = source.mapInArrow(partial(_combine, **options), "b binary, owner long, n long")
    keyed = local.select(F.octet_length("b").cast("long").alias("size"), F.xxhash64("b").alias("h"), "b", "owner", "n")
    dealt = keyed.repartition("size", "h").drop("h").sortWithinPartitions("size", "b")
    owners = table(dealt.mapInArrow(partial(_own, **options), "size long, sha string, owner long, n long"), "owners")
    bound = max(LARGE, (owners.agg(F.sum("n")).first()[0] or 0) // MOST_LARGE)
    large = owners.where(F.col("n") > bound).select(F.col("size").alias("large_size"), F.col("sha").alias("large_sha"), F.col("owner").alias("large_owner"), F.col("n").alias("large_n"))
    rows = source.select("id", F.octet_length("b").cast("long").alias("size"), F.sha2("b", 256).alias("sha"))
    rows = rows.join(F.broadcast(large), (F.col("size") == F.col("large_size")) & (F.col("sha") == F.col("large_sha")), "left")
    aside = F.when(F.col("large_n").isNotNull(), -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 20)))  # these meet no owner again, and not each other
    rows = rows.withColumn("size", F.coalesce(aside, F.col("size")))
    out = rows.join(owners.where(F.col("n") <= bound), ["size", "sha"], "left")
    owner = F.when(F.col("large_n").isNotNull(), F.col("large_owner")).otherwise(F.col("owner"))
    return out.select(
        F.col("id").alias(id_col),
        owner.alias("keep_id"),
        F.coalesce("large_n", "n").alias("group_size"),
        F.coalesce(F.col("id") == owner, owner.isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
