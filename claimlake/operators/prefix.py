"""Running sums in an order, by ranges: no window is wider than a range, whatever the keys.

Rows are written once in ranges of the order, with the range they lie in; sums of the ranges are added up before them, and
each range counts from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.runtime import written

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def running(df: DataFrame, value: str, order: list[str], keys: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with before: the sum of ``value`` over the rows of the same ``keys`` that come before in ``order``, which has to
    tell the rows of a key apart. Ranges go by keys and order, so a frequent key is in many of them and rare ones share
    one. The window over ranges has a row for each key in each range, at most ``ranges`` of one key."""
    ranges = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    dealt = written(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_range")]
    met = dealt.alias("d").join(sums.alias("s"), same).select("d.*", "s._ahead")
    own = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("before", F.col("_ahead") + F.coalesce(F.sum(value).over(own), F.lit(0))).select(*df.columns, "before")
