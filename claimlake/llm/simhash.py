"""SimHash near-duplicates by a self-join of binary tries.

1. Every text becomes a fingerprint: bit b is set where more than half of the XXH64 of its 3-word shingles, repeats
   included, have bit b. Equal fingerprints are one class under its smallest id; only classes go on.
2. The 64 bits are cut into one block more than the error budget. Of two fingerprints within the budget one block is
   equal, so for each block there is a trie of all classes that begins with it: its upper levels, where no error is
   allowed, are dealt out as keys, each of which is the root of a subtree.
3. A subtree is joined with itself: node pairs go down together, the bits in which they differ are added up, and a pair
   is dropped once they exceed the budget. A node is a range of the sorted fingerprints, levels at which neither node
   forks are taken in one step, and all pairs of a round are handled at once, depth first by rounds of bounded size.
4. A root with more than NODE_ROWS classes is taken further down before it is dealt out: the bits that split it best are its next
   levels, and its pairs of nodes within the budget (those that exist) are what is dealt. This is repeated until no pair is
   larger, so a group of near copies of any size is many small tasks; distinct fingerprints always part at some bit.
5. Links leave a task as stars, and components give the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import few, runs, table, text_bytes, with_owner
from claimlake.llm.components import components, star_batch
from claimlake.llm.textkit import LOWER, SPACE, chunks, words

SIZE, SEED, BITS, BUDGET = 3, 42, 64, 2
#: Classes of a pair of nodes that one task joins at once; levels by which a larger one goes down in one round.
NODE_ROWS, LEVELS = 1 << 16, 6
#: Node pairs of a round; pairs of so few members are compared one by one.
ROUND, FEW = 1 << 16, 16


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each document of the batch; 0 for one without words."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    counts = np.diff(first)
    # Words joined by single spaces: of each gap only its first byte stays.
    inside = np.append(~SPACE[data], False)
    keep = inside.copy()
    keep[ends] = True
    joined = np.append(data, np.uint8(0x20))
    joined[keep & ~inside] = 0x20
    place = np.concatenate([[0], np.cumsum(keep)])
    text = joined[keep].tobytes()
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    head = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    last = np.minimum(head + size, first[doc + 1]) - 1
    digest = xxhash.xxh64_intdigest
    bounds = zip(place[starts[head]].tolist(), place[ends[last]].tolist(), strict=True)
    hashes = np.fromiter((digest(text[a:b], seed) for a, b in bounds), np.uint64, len(doc))
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        ones = _ones(hashes, np.concatenate([[0], np.cumsum(n[some])]))
        bits = (2 * ones > n[some][:, None]).astype(np.uint64)
        out[some] = (bits << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def _ones(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each bit: eight counters of a byte are added up in one word, 255 at a time."""
    pieces = -(-np.diff(bounds) // 255)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(bounds[:-1], pieces) + 255 * nth
    lanes, out = np.uint64(0x0101010101010101), np.empty((len(pieces), BITS), np.int64)
    runs_of = np.cumsum(pieces) - pieces
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        out[:, k::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), runs_of)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch["b"]):
            found = fingerprints(data, offsets, size)
            yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), pa.array(found.view(np.int64))], names=["id", "fp"])


def trie_links(values: np.ndarray, a: np.ndarray, b: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of values at most ``budget`` bits apart, from node pairs: rows (first, end) of ``a`` and ``b`` are ranges
    of ``values``, each sorted and distinct; equal rows are a node with itself, others do not overlap."""
    stack = [(a[k : k + ROUND], b[k : k + ROUND]) for k in range(0, len(a), ROUND)]
    one = np.uint64(1)
    while stack:
        a, b = stack.pop()
        # The bits above the first fork of either node are the same in all of its members.
        forks = (values[a[:, 0]] ^ values[a[:, 1] - 1]) | (values[b[:, 0]] ^ values[b[:, 1] - 1])
        below = forks.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            below |= below >> np.uint64(shift)
        spent = np.bitwise_count((values[a[:, 0]] ^ values[b[:, 0]]) & ~below)
        own = (a == b).all(1)
        alive = (spent <= budget) & ~(own & (a[:, 1] - a[:, 0] == 1))
        a, b, below, own = a[alive], b[alive], below[alive], own[alive]
        small = (a[:, 1] - a[:, 0]) * (b[:, 1] - b[:, 0]) <= FEW
        if small.any():
            x, y = a[small], b[small]
            wide = y[:, 1] - y[:, 0]
            n = (x[:, 1] - x[:, 0]) * wide
            pair = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = x[pair, 0] + at // wide[pair], y[pair, 0] + at % wide[pair]
            near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & ((i < j) | ~own[small][pair])
            yield i[near], j[near]
            a, b, below, own = a[~small], b[~small], below[~small], own[~small]
        if not len(a):
            continue
        bit = below ^ (below >> one)
        middle_a, middle_b = _middle(values, a, bit), _middle(values, b, bit)
        low_a, high_a = np.stack([a[:, 0], middle_a], 1), np.stack([middle_a, a[:, 1]], 1)
        low_b, high_b = np.stack([b[:, 0], middle_b], 1), np.stack([middle_b, b[:, 1]], 1)
        left = np.concatenate([low_a, high_a, low_a, high_a[~own]])
        right = np.concatenate([low_b, high_b, high_b, low_b[~own]])
        full = (left[:, 0] < left[:, 1]) & (right[:, 0] < right[:, 1])
        left, right = left[full], right[full]
        stack += [(left[k : k + ROUND], right[k : k + ROUND]) for k in range(0, len(left), ROUND)]


def _middle(values: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where in each range the members with ``bit`` begin; all have the same bits above it."""
    low, high = node[:, 0].copy(), node[:, 1].copy()
    while (low < high).any():
        mid = (low + high) // 2
        on = (values[np.minimum(mid, len(values) - 1)] & bit) > 0
        open_ = low < high
        high = np.where(open_ & on, mid, high)
        low = np.where(open_ & ~on, mid + 1, low)
    return low


def _join_tries(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pair, side, turned): of each pair of nodes the links between its sides, or within its only one."""
    for part in runs(batches, ["pair"]):
        pair, side, turned, rep = (part[c].to_numpy() for c in ("pair", "side", "turned", "rep"))
        values = turned.view(np.uint64) ^ np.uint64(1 << 63)  # signed order to unsigned
        change = np.flatnonzero((pair[1:] != pair[:-1]) | (side[1:] != side[:-1])) + 1
        starts = np.concatenate([[0], change])
        node = np.stack([starts, np.append(change, len(pair))], 1)
        own = side[starts] == 0  # a node with itself; 1 and 2 are the sides of a pair
        first = np.flatnonzero((side[starts] == 1)[:-1] & (side[starts] == 2)[1:] & (pair[starts][1:] == pair[starts][:-1]))
        a, b = np.concatenate([node[own], node[first]]), np.concatenate([node[own], node[first + 1]])
        u, v, held = [], [], 0
        for i, j in trie_links(values, a, b, budget):
            u.append(rep[i]), v.append(rep[j])
            held += len(i)
            if held > 1 << 20:
                yield star_batch(np.concatenate(u), np.concatenate(v))
                u, v, held = [], [], 0
        if held:
            yield star_batch(np.concatenate(u), np.concatenate(v))


def _turned(fp: Column, width: int) -> Column:
    """The fingerprint with its upper ``width`` bits at the end, in signed order."""
    return fp if not width else F.shiftleft(fp, width).bitwiseOR(F.shiftrightunsigned(fp, BITS - width))


def _bits(large: DataFrame, levels: int) -> DataFrame:
    """pair, bits: those that part its sides most evenly. Bits that are the same in all of a side are left out: what
    they cost is known already or is found at the end."""
    bit = lambda b: F.shiftrightunsigned("turned", b).bitwiseAND(F.lit(1))
    sides = large.groupBy("pair", "side").agg(F.count("*").alias("m"), *[F.sum(bit(b)).alias(f"s{b}") for b in range(BITS)])
    off = F.array(*[F.struct(F.sum(F.abs(2 * F.col(f"s{b}") - F.col("m"))).alias("off"), F.lit(b).alias("b")) for b in range(BITS)])
    pairs = sides.groupBy("pair").agg(F.sum("m").alias("m"), F.sort_array(off).alias("off"))
    forks = F.filter("off", lambda x: x["off"] < F.col("m"))
    return pairs.select("pair", F.transform(F.slice(forks, 1, levels), lambda x: x["b"]).alias("bits"))


def _down(large: DataFrame, budget: int, levels: int) -> DataFrame:
    """Node pairs that are too large (pair, side, spent, turned, rep), some levels further down."""
    code = "aggregate(bits, 0L, (c, b) -> c * 2 + (shiftrightunsigned(turned, b) & 1L)) as child"
    held = table(large.join(few(table(_bits(large, levels), "bits")), "pair").selectExpr("pair", "side", "spent", "turned", "rep", code), "held")
    nodes = table(held.select("pair", "side", "spent", "child").distinct(), "nodes")
    x = nodes.select("pair", "spent", F.col("side").alias("side_x"), F.col("child").alias("x"))
    y = nodes.select("pair", F.col("side").alias("side_y"), F.col("child").alias("y"))
    met = x.join(y, "pair").where("(side_x = 0 and x <= y) or (side_x = 1 and side_y = 2)")  # at most 2 ** levels nodes a side
    met = met.withColumn("spent_now", F.col("spent") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).where(F.col("spent_now") <= budget)
    same = (F.col("side_x") == 0) & (F.col("x") == F.col("y"))
    way = lambda side, child, now: F.struct(F.col(side).alias("side"), F.col(child).alias("child"), F.lit(now).alias("side_now"))
    ways = F.explode(F.when(same, F.array(way("side_x", "x", 0))).otherwise(F.array(way("side_x", "x", 1), way("side_y", "y", 2))))
    route = met.select("pair", F.xxhash64("pair", "x", "y").alias("pair_now"), "spent_now", ways.alias("way")).select("pair", "pair_now", "spent_now", "way.*")
    moved = held.join(few(table(route, "route")), ["pair", "side", "child"])
    return moved.select(F.col("pair_now").alias("pair"), F.col("side_now").alias("side"), F.col("spent_now").alias("spent"), "turned", "rep")


def similar(classes: DataFrame, *, budget: int = BUDGET, node_rows: int = NODE_ROWS, levels: int = LEVELS) -> DataFrame:
    """(fp, rep) of distinct fingerprints -> edges (u, v) whose components are those of all links."""
    blocks = budget + 1
    at = [BITS * k // blocks for k in range(blocks + 1)]
    roots = F.array(*[F.struct(F.lit(k).alias("k"), _turned(F.col("fp"), at[k]).alias("turned")) for k in range(blocks)])
    rows = classes.select("rep", F.explode(roots).alias("r")).select("rep", "r.turned", "r.k")
    root = F.expr("case k " + " ".join(f"when {k} then shiftrightunsigned(turned, {BITS - at[k + 1] + at[k]})" for k in range(blocks)) + " end")
    rows = rows.select(F.xxhash64("k", root).alias("pair"), F.lit(0).alias("side"), F.lit(0).alias("spent"), "turned", "rep")
    done = []
    while True:
        rows = table(rows, "node_pairs")
        large = table(rows.groupBy("pair").agg(F.count("*").alias("m")).where(F.col("m") > node_rows).select("pair"), "large")
        if large.isEmpty():
            break
        large = few(large)
        done.append(rows.join(large, "pair", "left_anti"))
        rows = _down(rows.join(large, "pair"), budget, levels)
    for part in done:
        rows = rows.union(part)
    dealt = rows.select("pair", "side", "turned", "rep").repartition("pair").sortWithinPartitions("pair", "side", "turned")
    return table(dealt.mapInArrow(partial(_join_tries, budget=budget), "u long, v long"), "links")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, budget: int = BUDGET, node_rows: int = NODE_ROWS, levels: int = LEVELS) -> DataFrame:
    """-> one row per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Texts of any length are taken
    whole. Rows repeated under one id are all returned, and what each of them links to is linked through the id. A row
    without an id links to nothing: component_id null. Which of equal fingerprints stands for them changes no row. An
    empty table gives no rows; other columns are not looked at.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("b"))
    sketch = table(source.mapInArrow(partial(_sketch, size=size), "id long, fp long"), "sketch")
    classes = table(sketch.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    edges = similar(classes.where("rep is not null").select("fp", "rep"), budget=budget, node_rows=node_rows, levels=levels)
    mixed = sketch.where("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    mixed = table(mixed.join(sketch, "id").select(F.col("id").alias("u"), "fp").distinct(), "repeated")
    edges = edges.union(mixed.join(classes, "fp").select("u", F.col("rep").alias("v")))
    found = components(table(edges, "edges")).withColumnRenamed("node", "rep")
    owners = table(classes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"), "m"), "owners")
    out = with_owner(sketch, owners, ["fp"], "m")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
