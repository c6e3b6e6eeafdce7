"""Equi-joins that stay even where a key is hot on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.runtime import written

#: Rows of a side in a block; a task's share of a hot key is a block of each side.
BLOCK = 2_000


def _parts(df: DataFrame, on: list[str], name: str, block: int) -> DataFrame:
    return df.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias(name))


def block_join(left: DataFrame, right: DataFrame, on: list[str], block: int = BLOCK) -> DataFrame:
    """The inner join of two tables (other columns differ) on columns that are not null.

    The rows of a key with more than ``block`` on a side are dealt, by a hash of the row, into parts of about that many; each
    part of one side meets each of the other as a key of its own, so no task has more than two parts, however many rows a
    key has. Which keys those are goes by a grouped count of both sides; without any it is a plain join."""
    both = _parts(left, on, "_pl", block).join(_parts(right, on, "_pr", block), on)
    hot = both.where("_pl > 1 or _pr > 1")
    if hot.isEmpty():
        return left.join(right, on)
    hot = written(hot, "hot_keys")

    def dealt(df: DataFrame, own: str, other: str, parts: tuple[str, str]) -> DataFrame:
        row = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(parts[0]), F.lit(1)).cast("long"))
        met = df.join(hot, on, "left").withColumns({own: row, other: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(parts[1]), F.lit(1)).cast("long") - 1))})
        return met.drop("_pl", "_pr")

    return dealt(left, "_l", "_r", ("_pl", "_pr")).join(dealt(right, "_r", "_l", ("_pr", "_pl")), [*on, "_l", "_r"]).drop("_l", "_r")
