"""Connected components of an edge table.

No more than ``LOCAL_EDGES`` edges are contracted to stars by one task. Of more, each task first contracts those that it
reads, a million at a time, so a group whose edges lie together leaves it as one edge a node. What is left goes through
alternating large-star and small-star rounds until one task can take it or nothing changes: two grouped minima and two
equi-joins each, spread by node, with the edges of the few nodes that have very many joined where they are. Rounds are
written tables in the shared folder; the driver gets counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import drop, table

#: Edges (two longs each) that a task contracts at once.
LOCAL_EDGES = 1_000_000
#: Nodes with more edges than this take part in the join by broadcast; the bound rises with the edges so that no more
#: than MOST_HUBS nodes can have so many.
HUB_EDGES, MOST_HUBS = 1000, 100_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges with the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, high[apart], low[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def star_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Edges (u, v), v < u, to the smallest node of each component."""
    node, root = stars(u, v)
    other = node != root
    return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], names=["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch], edges: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= edges:
            one = pa.Table.from_batches(held)
            held = [star_batch(one["u"].to_numpy(), one["v"].to_numpy())]
            n = held[0].num_rows
            if n > edges // 2:
                yield held.pop()
                n = 0
    if held:
        one = pa.Table.from_batches(held)
        yield star_batch(one["u"].to_numpy(), one["v"].to_numpy())


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        one = pa.Table.from_batches(held)
        node, root = stars(one["u"].to_numpy(), one["v"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """One half round as a table; what it is joined with is a table too, so plans stay small however many rounds."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = table(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n"), "least")
    rest = near.where("v > u") if large else near
    linked = None
    if (least.agg(F.max("n")).first()[0] or 0) > hub:  # a hub's edges stay where they are: they would be one task's
        hubs = least.where(F.col("n") > hub).select(F.col("w").alias("h"), F.col("m").alias("hm"))
        routed = rest.join(F.broadcast(hubs), F.col("u") == F.col("h"), "left")
        linked = routed.where("h is not null").select(F.col("v").alias("u"), F.col("hm").alias("v"))
        rest = routed.where("h is null").select("u", "v")
    others = rest.join(least.select("w", "m"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = linked.union(others) if linked is not None else others
    if not large:
        linked = linked.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    out = table(linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    drop(least)
    return out


def components(edges: DataFrame, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``edges`` (u, v) of any order, loops and repeats allowed, null ends ignored -> (node, component), one row
    for each node with an edge to another; ``component`` is the smallest node that it reaches. No edges, no rows.
    ``edges`` is read more than once; give a table."""
    now = edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(now)
    if before[0] > local_edges:
        now = table(now.mapInArrow(lambda batches: _contract(batches, max(2, local_edges)), "u long, v long"), "edges")
        before = print_of(now)
    while before[0] > local_edges:
        hub = max(HUB_EDGES, 2 * before[0] // MOST_HUBS)
        half = _star(now, True, hub)
        after = _star(half, False, hub)
        drop(half), drop(now)
        now, seen = after, print_of(after)
        if seen == before:  # stars, each node under its component
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())
        before = seen
    return table(now.coalesce(1).mapInArrow(_settle, "node long, component long"), "components")
