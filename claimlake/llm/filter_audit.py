"""Interaction of filters as an incidence matrix product.

1. One scan of the whole texts gives each row the mask of the filters that it fails (the text's own four), its part and
   the SHA-256 of its text. Whether an equal text has a smaller id is asked of these narrow rows: a grouped minimum,
   combined where the rows lie, and an equi-join that carries the id, so a text with a third of all rows is spread.
2. Rows are counted by (part, mask): at most 32 numbers a part, as three histograms: all rows, good ones, toxic ones.
3. The histograms of a batch of parts are stacked as rows of a matrix and multiplied by integer matrices of 32 masks by
   600 columns (120 orders of five filters, five steps each), one each for kept, removed, redundant and unique outcomes.
   The order of the filters is only in the matrices, so the corpus is never filtered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import table

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: (order, step) of each column of the matrices.
COLUMNS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
#: Parts whose histograms are multiplied at once; 600 rows come out of each.
PARTS = 64
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def outcomes() -> dict[str, np.ndarray]:
    """Matrices of masks by columns: 1 where a row with that mask is kept after the step, removed at it, fails its filter
    after it was removed, or fails it alone; ``shapley`` has the removals of the column's filter over all orders."""
    mask = np.arange(1 << len(FILTERS))[:, None]
    own = np.array([1 << FILTERS.index(order[step - 1]) for order, step in COLUMNS])
    before = np.array([sum(1 << FILTERS.index(f) for f in order[: step - 1]) for order, step in COLUMNS])
    fails, gone = (mask & own) > 0, (mask & before) > 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": (mask == own) & (own > 0)}
    out = {k: m.astype(np.int64) for k, m in out.items()}
    out["shapley"] = out["removed"] @ (own[:, None] == own[None, :]).astype(np.int64)
    return out


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms (part, n, good, toxic: 32 longs each) to 600 rows a part."""
    matrices = outcomes()
    orders, steps = pa.array([o for o, _ in COLUMNS]), np.array([s for _, s in COLUMNS], np.int32)
    for big in batches:
        for at in range(0, big.num_rows, PARTS):
            batch = big.slice(at, PARTS)
            n, good, toxic = (np.array(batch[c].to_pylist(), np.int64).reshape(batch.num_rows, -1) for c in ("n", "good", "toxic"))
            columns = {k: n @ m for k, m in matrices.items()}
            columns |= {"good_lost": good @ matrices["removed"], "toxic_lost": toxic @ matrices["removed"]}
            whole = [batch["part"].take(pa.array(np.repeat(np.arange(batch.num_rows), len(COLUMNS)))), pa.concat_arrays([orders] * batch.num_rows), pa.array(np.tile(steps, batch.num_rows))]
            names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
            yield pa.RecordBatch.from_arrays([*whole, *(pa.array(columns[k].ravel()) for k in names)], names=["part", "filter_order", "step", *names])


def _characters(text: Column, kept: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", ""))


def text_mask(text: Column) -> Column:
    """Bits of the four filters that a text decides by itself."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n = F.size(words)
    fails = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * _characters(text, "A-Z") > 3 * F.char_length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """-> one row per row of ``docs``: part, mask (with the bit of repeated texts), good, toxic."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    sha = F.unhex(F.sha2(F.col("t").cast("binary"), 256))
    rows = docs.select("id", "part", sha.alias("sha"), text_mask(F.col("t")).cast("int").alias("mask"))
    # A row without an id comes after all that have one, and has no label: it goes by its text.
    rows = rows.select("part", "sha", "mask", F.col("id").isNull().alias("none"), F.coalesce("id", F.xxhash64("sha")).alias("key"))
    rows = table(rows, "rows")
    owner = rows.groupBy("sha").agg(F.min(F.struct("none", "key")).alias("o")).select("sha", "o.none", "o.key", F.lit(1).alias("first"))
    flags = labels.where("quality = 1 or toxic = 1").groupBy(F.col(id_col).cast("long").alias("key"))
    flags = flags.agg(F.max((F.col("quality").eqNullSafe(1)).cast("int")).alias("good"), F.max((F.col("toxic").eqNullSafe(1)).cast("int")).alias("toxic"))
    flags = flags.where("key is not null").withColumn("none", F.lit(False))
    marked = rows.join(owner, ["sha", "none", "key"], "left").join(flags, ["none", "key"], "left")
    mask = F.col("mask") + F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return marked.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """-> per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts count as empty, which fail A, and E where an equal text has a smaller id; a null part is the part of the
    empty string. Texts of any length are taken whole. Rows that repeat an id with its text are each counted and none
    is the other's copy, as neither id is smaller. A row without an id comes after all rows that have one and has no
    label; such rows are no copies of each other. A document is good (toxic) if any label of its id says 1; labels of
    other ids and null labels say nothing. An empty table gives no rows; other columns are not looked at.
    """
    counted = masks(docs, labels, id_col, text_col, part_col).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    kinds = ("n", "good", "toxic")
    wide = counted.groupBy("part").agg(*[F.array(*[F.sum(F.when(F.col("mask") == m, F.col(k)).otherwise(0)) for m in range(1 << len(FILTERS))]).alias(f"h_{k}") for k in kinds])
    return wide.select("part", *[F.col(f"h_{k}").alias(k) for k in kinds]).mapInArrow(_multiply, _SCHEMA)


#: What the rows are in SQL: every document meets every order.
ORACLE = """
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), fails as (
  select w.doc_id, part,
         (case when len(ws) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end)
         || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end)
         || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) || (case when min(w.doc_id) over (partition by text) < w.doc_id then 'E' else '' end) as f,
         coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
  from words w left join labels l on l.doc_id = w.doc_id
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select filter_order, step::int as step, filter_order[step] as own, filter_order[:step - 1] as before from orders, (select unnest(range(1, 6)) as step)
), met as (
  select part, filter_order, step, own, contains(f, own) as own_fails, regexp_matches(f, '[' || before || '-]') as gone, f = own as alone, good, toxic from fails, steps
), counts as (
  select part, filter_order, step, own, count(*) filter (not own_fails and not gone) as kept, count(*) filter (own_fails and not gone) as removed, count(*) filter (own_fails and gone) as redundant,
         count(*) filter (alone) as unique_fails, count(*) filter (own_fails and not gone and good) as good_lost, count(*) filter (own_fails and not gone and toxic) as toxic_lost
  from met group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from counts"""
