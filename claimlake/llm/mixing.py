"""Mixing sources to target weights, in DataFrame expressions only.

Sizes are summed by source (partial sums first, so a hot source costs one row a task). Targets follow from one
water level: sources sorted by limit / weight are filled to their limit until the level that the rest shares by
weight no longer reaches it. A source's rate is target / size; each document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with the fraction as its probability. Of ``SEEDS`` hash seeds each source takes the one
whose total comes nearest its target (the smallest of equals), so a run agrees with every other run on the same rows.

What the choice of a seed does to the probability: totals over and under the target are equally good, so a document's
coin is tied to the choice only through its own share of the total's spread, and to first order both directions cancel.
For a document that is small beside the spread of its source's total, the probability is the fraction; one that makes up
most of a source leans towards the copy count that is nearer the target. ``seeds=1`` gives plain Bernoulli copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlake.llm.common import WORD, table

#: Candidate seeds; each reads 52 bits of a SHA-256, four of which fit in one digest.
SEEDS = 8
#: A table of sources of up to so many rows (seven numbers each) is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1): 52 bits of SHA-256 over "<digest number>:<id>"; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed // 4}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 13 * (seed % 4), 13), 16, 10).cast("long") / F.lit(float(2**52))


def _copies(rate: Column, uniform: Column) -> Column:
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("int")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """(source, size) rows -> one row per source: source, source_size, target, rate. Windows run over this small
    table only."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    w = by_source.withColumn("w", weight).withColumn("most", F.col("source_size") * limit)
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    w = w.withColumns(
        {
            "k": F.row_number().over(fill),
            "filled": F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "ahead": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
            "wanted": F.sum("source_size").over(whole) * F.lit(float(share)),
        }
    )
    w = w.withColumn("level", (F.col("wanted") - F.col("filled")) / F.col("ahead"))
    w = w.withColumn("first", F.min(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("k"))).over(whole))
    w = w.withColumn("last_level", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(whole))
    full = F.col("first").isNull() | (F.col("k") < F.col("first"))
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("w") * F.col("last_level"))
    out = w.select("source", "source_size", target.alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def rates(sizes: DataFrame, *, seeds: int = SEEDS, **options) -> DataFrame:
    """(id, source, size) rows -> one row per source with its rate and seed (one of ``seeds``, SEEDS at most), as a
    table in the shared folder."""
    if not 1 <= seeds <= SEEDS:
        raise ValueError(seeds)
    by_source = targets(sizes, **options)
    small = by_source.select(F.col("source").alias("s"), "rate")
    taken = [F.sum(F.col("size") * _copies(F.col("rate"), _uniform(F.col("id"), j))).alias(f"t{j}") for j in range(seeds)]
    sums = sizes.join(small, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(*taken).withColumnRenamed("source", "s")
    misses = F.array(*[F.abs(F.col(f"t{j}") - F.col("target")) for j in range(seeds)])
    best = (F.array_position(misses, F.array_min(misses)) - 1).cast("int")
    found = by_source.join(sums, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "rate", best.alias("seed"))
    return table(found, "rates")


def _with_rates(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    by_source = by_source.withColumnRenamed("source", "s")
    if by_source.count() <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    uniform = F.coalesce(*[F.when(F.col("seed") == j, _uniform(F.col("id"), j)) for j in range(SEEDS)])
    return rows.join(by_source, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies(F.col("rate"), uniform))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """-> one row per row of ``docs``: id, size, source_size, target, taken, copies.

    Null and empty texts have size 0; null is a source, the last one. A source without words has target and rate
    0. Rows repeated under one id share their coin. An empty table gives no rows. Options: ``weights`` (repeated
    over the sources by code point), ``share`` of all sizes, ``limit`` times a source's size.
    """
    sizes = table(_sizes(docs, id_col, text_col, source_col), "sizes")
    rows = _with_rates(sizes, rates(sizes, **options))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as ``mixture`` says, with the columns of ``docs``. Null and empty
    texts have size 0 and copies like any other of their source; rows repeated under one id share their coin; texts are
    carried whole; names of the columns may be any. An empty table gives no rows."""
    by_source = rates(table(_sizes(docs, id_col, text_col, source_col), "sizes"), **options)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    return _with_rates(held, by_source).select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


ORACLE = """
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), by_source as (
  select source, sum(size)::bigint as source_size from sizes group by source
), weighed as (
  select *, source_size * 2 as most, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from by_source
), filling as (
  select *, row_number() over f as k, coalesce(sum(most) over (f rows between unbounded preceding and 1 preceding), 0)::bigint as filled,
         (sum(w) over (f rows between current row and unbounded following))::bigint as ahead,
         (sum(source_size) over ())::bigint * 1.5::double as wanted
  from weighed window f as (order by most / w, source nulls last)
), levels as (
  select *, (wanted - filled) / ahead as level from filling
), firsts as (
  select *, min(case when most / w > level then k end) over () as first from levels
), aims as (
  select source, source_size,
         case when first is null or k < first then most::double else w * max(case when k = first then level end) over () end as target
  from firsts
), rated as (
  select *, case when source_size > 0 then target / source_size else 0 end as rate from aims
), coins as (
  select s.doc_id, s.source, s.size, r.source_size, r.target, r.rate, j.j,
         ('0x' || substr(sha256(concat((j.j // 4)::varchar, ':', coalesce(s.doc_id::varchar, ''))), 1 + 13 * (j.j % 4), 13))::bigint / 4503599627370496::double as u
  from sizes s join rated r on s.source is not distinct from r.source cross join (select unnest(range(8)) as j) j
), copied as (
  select *, (floor(rate) + (u < rate - floor(rate))::int)::bigint as copies from coins
), misses as (
  select source, j, abs(sum(size * copies)::bigint - any_value(target)) as miss from copied group by source, j
), chosen as (
  select source, arg_min(j, (miss, j)) as seed from misses group by source
)
select c.doc_id, c.size, c.source_size, c.target, (c.size * c.copies)::bigint as taken, c.copies
from copied c join chosen h on c.source is not distinct from h.source and c.j = h.seed"""
