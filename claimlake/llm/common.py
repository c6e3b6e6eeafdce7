"""What the operators share: tables in the shared folder, safe column access, text as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.runtime import delete, scratch

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many narrow rows of a written table are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Groups of more rows than this meet their rows by broadcast; the bound rises with the rows so that no more than
#: MOST_LARGE groups can have so many.
LARGE, MOST_LARGE = 1000, 100_000


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends here, a lost executor costs
    a reread, and no expensive plan runs twice. The files go when the driver's interpreter ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._claimlake_path = path  # type: ignore[attr-defined]
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by ``table`` that no later plan reads."""
    delete(df.sparkSession, df._claimlake_path.rsplit("/", 1)[0])  # type: ignore[attr-defined]


def few(df: DataFrame) -> DataFrame:
    """A written table, broadcast where its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_owner(rows: DataFrame, owners: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group's row in ``owners`` (rows in the group: ``size``); rows of no group are
    dropped. Large groups' rows stay where they are. Both are read more than once; give tables."""
    bound = max(LARGE, (owners.agg(F.sum(size)).first()[0] or 0) // MOST_LARGE)
    large, small = owners.where(F.col(size) > bound), owners.where(F.col(size) <= bound)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(rest.join(small, keys))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores is dealt out to all of them; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts a partition sorted by ``keys`` into pieces that end where a key ends; a piece holds one batch
    or, where a key's rows go on, as many as that key needs."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last, first = held[-1].slice(held[-1].num_rows - 1, 1), batch.slice(0, 1)
            if any(last[k] != first[k] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        cut = 0
        if batch.num_rows > 1:
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                column = batch[k].to_numpy(zero_copy_only=False)
                change |= column[1:] != column[:-1]
            at = np.flatnonzero(change)
            cut = int(at[-1]) + 1 if len(at) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
