"""Paths and closures by doubling: a chain of n links takes log2(n) rounds.

Each round is one written table, so plans stay small, lineage ends and a lost executor costs a reread; the counts that end
the loop are taken while it is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from claimlake.runtime import written

#: Up to so many steps (about 20 MB) go with the tasks that walk them; rounds of doubling take more.
FEW_STEPS = 150_000


def _round(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict]:
    seen = Observation(name)
    return written(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name), seen.get


def _walked(first: DataFrame, steps: dict) -> DataFrame:
    """The paths from each start where the steps are few."""
    kind = first.schema["start"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"start": [], "pos": [], "node": [], "again": []}
            for start in batch["start"].to_pylist():
                path, at = {}, start
                while at is not None and at not in path:
                    path[at] = len(path)
                    at = steps.get(at)
                out["start"] += [start] * len(path)
                out["node"] += path
                out["pos"] += path.values()
                out["again"] += [at is not None] * len(path)
            kinds = (batch.schema.field("start").type, pa.int64(), batch.schema.field("start").type, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return first.mapInArrow(walk, f"start {kind}, pos long, node {kind}, again boolean")


def follow(starts: DataFrame, steps: DataFrame, few: int = FEW_STEPS) -> DataFrame:
    """starts (start) and steps (node, to), one ``to`` for a node -> start, pos, node, again: the nodes from a start (at 0) on,
    each where it comes first; ``again`` holds on some row of a start whose path comes back to one of them.

    Up to ``few`` steps (a bound on what the driver and each task hold) are walked where the starts are. For more, before round
    k a table holds what is 2 ** k steps on from each node that has so much ahead of it, and the paths up to
    that length; both meet it once more. It ends when no path grew."""
    steps = steps.where("node is not null and to is not null").distinct()
    first = starts.where("start is not null").distinct()
    held = steps.limit(few + 1).toArrow()
    if held.num_rows <= few:
        return _walked(first, dict(zip(held["node"].to_pylist(), held["to"].to_pylist(), strict=True)))
    del held
    path = first.select(F.lit(True).alias("is_path"), F.col("start").alias("a"), F.col("start").alias("b"), F.lit(0).cast("long").alias("pos"), F.lit(False).alias("again"))
    jump = steps.select(F.lit(False).alias("is_path"), F.col("node").alias("a"), F.col("to").alias("b"), F.lit(1).cast("long").alias("pos"), F.lit(False).alias("again"))
    paths, counts = _round(path.unionByName(jump), "paths", n=F.count_if("is_path"), jumps=F.count_if(~F.col("is_path")))
    while counts["jumps"]:
        before = counts["n"]
        path, jump = paths.where("is_path"), paths.where("not is_path").select(F.col("a").alias("from"), F.col("b").alias("onward"), F.col("pos").alias("stride"))
        on = paths.join(jump, F.col("b") == F.col("from")).select("is_path", "a", F.col("onward").alias("b"), (F.col("pos") + F.col("stride")).alias("pos"), "again")
        grown = path.unionByName(on.where("is_path")).groupBy("a", "b").agg(F.min("pos").alias("pos"), (F.max("again") | (F.count("*") > 1)).alias("again"))
        grown = grown.select(F.lit(True).alias("is_path"), "a", "b", "pos", "again")
        paths, counts = _round(grown.unionByName(on.where("not is_path")), "paths", n=F.count_if("is_path"), jumps=F.count_if(~F.col("is_path")))
        if counts["n"] == before:
            break
    return paths.where("is_path").select(F.col("a").alias("start"), "pos", F.col("b").alias("node"), "again")


def reach(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> root, cur, depth: every other node that can be reached, with the least number of steps.

    Of a least path longer than 2 ** k one node lies exactly 2 ** k steps from its root, so pairs that far apart meet all
    pairs found so far; it ends when no pair is that far apart."""
    edge = edges.where("a is not null and b is not null and a <> b").distinct()
    pairs, counts = _round(edge.select(F.col("a").alias("root"), F.col("b").alias("cur"), F.lit(1).alias("depth")), "pairs", n=F.count("*"), far=F.count("*"))
    length = 1
    while counts["far"]:
        half = pairs.where(F.col("depth") == length).select("root", F.col("cur").alias("mid"))
        rest = pairs.select(F.col("root").alias("mid"), "cur", (F.col("depth") + length).alias("depth"))
        longer = pairs.unionByName(half.join(rest, "mid").where("root <> cur").select("root", "cur", "depth"))
        length *= 2
        pairs, counts = _round(longer.groupBy("root", "cur").agg(F.min("depth").alias("depth")), "pairs", far=F.count_if(F.col("depth") == length))
    return pairs
