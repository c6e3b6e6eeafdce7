"""Windows that open where the last one has ended, cut anywhere.

What opens next depends on what opened last, but each point has one successor whatever came before it: the first point more
than a span later. Successors are found in buckets a span wide, so a key's points are never one task's, and the openers are
the path of successors from a key's first point, which doubling finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.operators.closure import follow

#: Buckets that are looked through at once for the next one with a point.
BUCKETS = 4096


def _bucket(t: Column, span: float) -> Column:
    return F.floor(t / span)


def _after(df: DataFrame, keys: list[str], order: list[str], value: Column) -> Column:
    """The least ``value`` of the rows behind each."""
    return F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing))


def successors(points: DataFrame, span: float, strict: bool) -> DataFrame:
    """Distinct points (key, t) -> key, t, next: the first point of the key later than t + span, or with ``strict`` off at it.
    Dividing and rounding down keep order, so a later point is in the bucket of t + span or behind it."""
    limits = points.select("key", F.col("t").alias("of"), (F.col("t") + span).alias("t"))
    # Where a point lies on a limit, the limit comes behind it if the point does not count.
    both = points.select("key", "t", F.lit(None).cast("double").alias("of"), F.lit(int(not strict)).alias("k"))
    both = both.unionByName(limits.withColumn("k", F.lit(int(strict)))).withColumn("bucket", _bucket(F.col("t"), span))
    here = _after(both, ["key", "bucket"], ["t", "k"], F.when(F.col("of").isNull(), F.col("t")))
    near = both.withColumn("here", here).where("of is not null").select("key", "bucket", "of", "here")
    heads = both.groupBy("key", "bucket").agg(F.min(F.when(F.col("of").isNull(), F.col("t"))).alias("head")).withColumn("part", F.floor(F.col("bucket") / BUCKETS))
    parts = heads.groupBy("key", "part").agg(F.min("head").alias("head"))
    parts = parts.select("key", "part", _after(parts, ["key"], ["part"], F.col("head")).alias("behind"))
    in_part = heads.select("key", "part", "bucket", _after(heads, ["key", "part"], ["bucket"], F.col("head")).alias("ahead"))
    far = in_part.join(parts, ["key", "part"]).select("key", "bucket", F.coalesce("ahead", "behind").alias("far"))
    return near.join(far, ["key", "bucket"]).select("key", F.col("of").alias("t"), F.coalesce("here", "far").alias("next"))


def openers(points: DataFrame, span: float, strict: bool = True) -> DataFrame:
    """points (key, t double), repeats allowed -> key, n (from 0), t: the points that open, first the key's first, then each
    time the first later than the last opener's t + span (at it too with ``strict`` off). Rows without a key or t open
    nothing."""
    points = points.where("key is not null and t is not null").select("key", F.col("t").cast("double").alias("t")).distinct()
    named = lambda t: F.to_json(F.struct("key", F.col(t).alias("t")))
    steps = successors(points, span, strict).where("next is not null").select(named("t").alias("node"), named("next").alias("to"))
    first = points.groupBy("key").agg(F.min("t").alias("t")).select(named("t").alias("start"))
    point = F.from_json("node", f"key {dict(points.dtypes)['key']}, t double")
    return follow(first, steps).select(point.alias("p"), F.col("pos").alias("n")).select("p.key", "n", "p.t")


def windows(records: DataFrame, key: str, ts: str, span: float) -> DataFrame:
    """``records`` with window: the number of the opener at or before each, by the bucket that it lies in."""
    opened = openers(records.select(F.col(key).alias("key"), F.col(ts).alias("t")), span)
    bucket = _bucket(F.col("t"), span)
    reached = opened.select("key", F.col("n").alias("window"), F.col("t").alias("opens"), F.explode(F.sequence(bucket, bucket + 2)).alias("_bucket"))
    met = records.withColumn("_bucket", _bucket(F.col(ts).cast("double"), span)).withColumn("key", F.col(key)).join(reached, ["key", "_bucket"])
    return met.where((F.col("opens") <= F.col(ts)) & (F.col(ts) <= F.col("opens") + span)).select(*records.columns, "window")
