"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into buckets of about ``bucket_bytes`` by a seeded hash; pass two takes a bucket
in memory, in an order that does not depend on how it arrived, and shuffles it with a seeded Fisher-Yates. Buckets
laid end to end are a random order of all records; dealing it out card by card gives shards whose counts are at most
one apart (law ``rows``), with gapless slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from claimlake.llm.common import runs, table, text_bytes

#: Bytes of records in a bucket, on average.
BUCKET_BYTES = 8 << 20
#: Starts of up to so many buckets are broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 1_000_000


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A uniform permutation of n: for i from the last down, swap i with a drawn j <= i."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))).random(n)
    picks = (draws * np.arange(1, n + 1)).astype(np.int64).tolist()
    out = order.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def _shuffle(batches: Iterator[pa.RecordBatch], seed: int, bucket: str, place: str) -> Iterator[pa.RecordBatch]:
    for part in runs(batches, [bucket]):
        numbers = part[bucket].to_numpy()
        cut = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
        for a, b in zip([0, *cut], [*cut, len(numbers)], strict=True):
            shuffled = part.slice(a, b - a).take(pa.array(fisher_yates(b - a, seed, int(numbers[a]))))
            yield from shuffled.append_column(place, pa.array(np.arange(b - a))).to_batches()


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def sharded(records: DataFrame, keys: list[str], size: Column, shards: int, *, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """-> ``records`` with shard and slot (names that ``records`` has get a trailing ``_``).

    ``keys`` give a record's bucket and its order before the shuffle; records with equal keys should be equal in
    all columns, as their order among themselves is left open. Nulls are values like any other. An empty table
    gives no rows. ``records`` is read more than once; give a table that is cheap to read.
    """
    bucket, place, first = (_free(n, records.columns) for n in ("bucket", "place", "first"))
    shard, slot = (_free(n, records.columns) for n in ("shard", "slot"))
    total = records.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    scattered = records.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)))
    counts = scattered.groupBy(bucket).count()
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(bucket).alias("of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    schema = StructType([*scattered.schema.fields, StructField(place, LongType())])
    dealt = scattered.repartition(bucket).sortWithinPartitions(bucket, F.xxhash64(F.lit(seed + 1), *keys), *keys)
    dealt = dealt.mapInArrow(partial(_shuffle, seed=seed, bucket=bucket, place=place), schema)
    at = F.col(first) + F.col(place)
    few = buckets <= BROADCAST_BUCKETS  # records are not shuffled again to meet their bucket's start
    out = dealt.join(F.broadcast(starts) if few else starts, F.col(bucket) == F.col("of"))
    return out.withColumns({shard: (at % shards).cast(IntegerType()), slot: F.floor(at / shards).cast("long")}).select(*[F.col(f"`{c}`") for c in records.columns], shard, slot)


def _dealt(docs: DataFrame, shards: int, id_col: str, text_col: str, **options) -> tuple[DataFrame, list[str]]:
    """Whole records with shard and slot, and the names of the two columns that were added to deal them by."""
    keys = [id_col, _free("crc32", docs.columns), _free("size", docs.columns)]
    text = text_bytes(F.col(text_col))
    held = table(docs.withColumns({keys[1]: F.crc32(text), keys[2]: (F.octet_length(text) + 16).cast("long")}), "records")
    return sharded(held, keys, F.col(keys[2]), shards, **options), keys[1:]


def document_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """-> one row per row of ``docs``: id, size (UTF-8 bytes + 16; null: 16), text_crc32 (null as empty), law
    "rows", shard, slot, grown_shard null. Size and checksum are those of the whole records after the shuffle. Rows
    repeated under one id are dealt each for itself, equal ones in any order; nulls are values like any other, texts of
    any length are carried whole, and other columns keep their names. An empty table gives no rows."""
    out, _ = _dealt(docs, shards, id_col, text_col, **options)
    shard, slot = out.columns[-2:]
    text = text_bytes(F.col(text_col))
    digests = (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    return out.select(id_col, *digests, F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Writes whole records, shuffled, as one folder ``shard=N`` for each shard; its files follow one another in slot
    order, and a shard of any size is written by as many tasks as it needs. Nulls, repeated rows, long texts and other
    columns as for ``document_shards``; shard and slot get a trailing ``_`` where ``docs`` has these names. An empty table
    writes no shard."""
    out, added = _dealt(docs, shards, id_col, text_col, **options)
    shard, slot = out.columns[-2:]
    out.drop(*added).repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
