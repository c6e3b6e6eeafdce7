"""Append-only logs as streams: arrival, windows, rate limits and gap checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimlake.runtime import scratch


def read_stream(spark: SparkSession, path: str, schema: str, format: str = "json", **options: str) -> DataFrame:
    """A folder of JSON lines or Parquet files that grows."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Appends to a Parquet folder, exactly once by checkpoint; ``once`` works off what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


#: States of several columns need this store; it also keeps large ones on disk.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(stream: DataFrame) -> DataFrame:
    """Queries that start from now on keep their state in ``STATE_STORE``."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream


def run_once(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Works off what a stream's source holds, exactly once, into a table of the shared folder, and gives that table.
    Windows that the watermark has not passed stay in the state; a later run with the same ``folder`` goes on from there."""
    spark = stream.sparkSession
    folder = folder or scratch(spark)
    append(stream, f"{folder}/table", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """At-least-once input to first occurrences, forgotten once the watermark has passed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, window: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Aligned tumbling windows with a watermark: start, key, n, mean."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, window), key)
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


class _Windows(StatefulProcessor):
    """Records wait in a list until the watermark has passed them, so they are taken in order of time whatever batch brought
    them; a timer takes them, and closes the open window once its end has passed too."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "n long, start double, count long, total double, open boolean")
        self.waiting = handle.getListState("waiting", "ts double, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for ts, value in zip(frame["ts"], frame["value"], strict=True):
                self.waiting.appendValue((float(ts), float(value)))
                first = float(ts) if first is None else min(first, float(ts))
        if first is not None:
            self._wait_for(first)
        yield from ()

    def _wait_for(self, ts: float) -> None:
        """A timer for the first record that waits; watermarks are whole milliseconds."""
        self.handle.registerTimer(math.ceil(ts * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        n, start, count, total, is_open = self.window.get() if self.window.exists() else (0, 0.0, 0, 0.0, False)
        waiting = sorted(self.waiting.get())
        due = [r for r in waiting if r[0] <= passed]
        out = []
        for ts, value in due:
            if is_open and ts > start + self.seconds:
                out.append((key[0], n, start, count, total))
                n, is_open = n + 1, False
            if not is_open:
                start, count, total, is_open = ts, 0, 0.0, True
            count, total = count + 1, total + value
        if is_open and start + self.seconds < passed:
            out.append((key[0], n, start, count, total))
            n, is_open = n + 1, False
        self.window.update((n, start, count, total, is_open))
        if due:
            self.waiting.put([(float(t), float(v)) for t, v in waiting[len(due) :]]) if len(waiting) > len(due) else self.waiting.clear()
            if len(waiting) > len(due):
                self._wait_for(float(waiting[len(due)][0]))
        if is_open:
            self.handle.registerTimer(math.floor((start + self.seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["rule_id", "window", "start", "n", "total"])

    def close(self) -> None:
        pass


def rule_windows(stream: DataFrame, seconds: float = 300, late: str = "10 minutes") -> DataFrame:
    """stream (rule_id string, ts double: seconds, value double) -> closed windows: rule_id, window, start, n, total. A window is
    opened by the first record after the last one expired, and closed by the first record behind its end or by the watermark,
    which follows the latest record by ``late``. Records may come in any order within that time, in any batches; later ones
    are dropped. What a rule holds are its open window and the records that the watermark has not passed."""
    at = F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))
    timed = with_state_store(stream.select("rule_id", "ts", "value")).withColumn("at", at).withWatermark("at", late)
    return timed.groupBy("rule_id").transformWithStateInPandas(_Windows(seconds), "rule_id string, window long, start double, n long, total double", "append", "EventTime")


class _Chain(StatefulProcessor):
    """The last event of each stream, across batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, hash string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seq, before = self.last.get() if self.last.exists() else (None, None)
        out = []
        events = sorted(e for frame in rows for e in zip(frame["seq"].astype("int64").tolist(), frame["hash"], frame["prev_hash"], frame["payload"], strict=True))
        for now, own, prev, payload in events:
            if seq is not None and now != seq + 1:
                out.append((key[0], now, "gap"))
            elif before is not None and prev != before:
                out.append((key[0], now, "chain"))
            if own != hashlib.sha256("\x1f".join(x for x in (prev, payload) if x is not None).encode()).hexdigest():
                out.append((key[0], now, "hash"))
            seq, before = now, own
        if events:
            self.last.update((seq, before))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "reason"])

    def close(self) -> None:
        pass


def broken_chain(stream: DataFrame) -> DataFrame:
    """stream (stream_id string, seq long, hash, prev_hash, payload strings) -> stream_id, seq, reason: a gap in the sequence, an
    event that does not name the hash of the one before, or one whose hash is not its own. A batch's events are taken in
    order of seq; the last one is kept for the next batch."""
    kept = with_state_store(stream.select("stream_id", "seq", "hash", "prev_hash", "payload"))
    return kept.groupBy("stream_id").transformWithStateInPandas(_Chain(), "stream_id string, seq long, reason string", "append", "None")


def sequence_gaps(stream: DataFrame) -> DataFrame:
    """stream (stream_id string, seq long) -> places where a sequence does not go on by one, across batches too."""

    def update(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for seq in sorted(int(s) for frame in frames for s in frame["seq"]):
            if last is not None and seq != last + 1:
                out.append((key[0], last, seq))
            last = seq
        state.update((last,))
        yield pd.DataFrame(out, columns=["stream_id", "previous", "seq"])

    return stream.groupBy("stream_id").applyInPandasWithState(update, "stream_id string, previous long, seq long", "last long", "append", GroupStateTimeout.NoTimeout)
