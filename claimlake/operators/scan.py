"""Order-dependent scans that no window expresses: rows of a key in order, with a small state between them.

A key's rows pass through one task in sorted batches; only the state is held, never the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def ordered_scan(df: DataFrame, key: str, order: list[str], result: StructField, start: Callable[[], Any], step: Callable[[Any, tuple], Any]) -> DataFrame:
    """Adds a column: ``step(state, row)`` gives its value and may change the state that ``start`` makes for each key."""
    at = df.columns.index(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, begun = None, None, False
        for frame in frames:
            values = []
            for row in frame.itertuples(index=False, name=None):
                if not begun or row[at] != current:
                    state, current, begun = start(), row[at], True
                values.append(step(state, row))
            frame[result.name] = pd.Series(values, index=frame.index, dtype="object")
            yield frame

    schema = StructType([*df.schema.fields, result])
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
