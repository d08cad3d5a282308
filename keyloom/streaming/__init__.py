"""Grouped reducers over streams.

The reducers are the built-in aggregates of ``keyloom.aggs``, which a streaming query keeps as state; so a
grouped reduction of a stream gives at any time what it would give on the rows seen so far.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame, quoted
from keyloom.operators.group import groupreduce


def stream_groupreduce(stream: DataFrame, f: Any, by: Any, sel: Any = None, time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A streaming grouped reduction; with ``time`` and ``window`` also by event-time windows.

    Rows later than ``late`` behind the newest time are dropped by the watermark, which also bounds the state.
    """
    if not stream.isStreaming:
        raise ValueError("this is no stream; use groupreduce")
    if time is None:
        return groupreduce(KeyedFrame(stream), f, by, sel).df
    marked = stream.withWatermark(time, late).withColumn("window", F.window(quoted(time), window))
    keys = [by] if isinstance(by, str) else list(by)
    return groupreduce(KeyedFrame(marked), f, ["window", *keys], sel).df
