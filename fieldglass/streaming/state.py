"""Streams: latest object per key, rate-limited recording, deduplicated live positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOST_MINUTES = 7


def windowed_means(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Means of `value` by key over sliding event-time windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy("key", F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def merged_latest(messages: DataFrame, valid: dict[str, tuple[float, float]]) -> DataFrame:
    """key, ms and fields: after each batch the state of every key that got a message.

    A message overwrites only fields that lie in their valid range; a key without a message
    for LOST_MINUTES of processing time is forgotten.
    """
    fields = list(valid)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = list(state.get) if state.exists else [0, *[None] * len(fields)]
        for pdf in frames:
            for row in pdf.sort_values("ms").itertuples(index=False):
                if row.ms < now[0]:
                    continue
                now[0] = int(row.ms)
                for i, f in enumerate(fields):
                    v = getattr(row, f)
                    if v is not None and valid[f][0] <= v <= valid[f][1]:
                        now[i + 1] = float(v)
        state.update(tuple(now))
        state.setTimeoutDuration(LOST_MINUTES * 60_000)
        yield pd.DataFrame([[key[0], *now]], columns=["key", "ms", *fields])

    schema = "ms long, " + ", ".join(f"{f} double" for f in fields)
    given = messages.select("key", "ms", *fields)
    return given.groupBy("key").applyInPandasWithState(update, f"key long, {schema}", schema, "update", GroupStateTimeout.ProcessingTimeTimeout)


def accepted_positions(messages: DataFrame, least_ms: int = 0) -> DataFrame:
    """Messages newer, by at least `least_ms`, than the last one accepted of their key; others are dropped."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(10**15)
        rows = []
        for pdf in frames:
            for ms in sorted(pdf["ms"].tolist()):
                if ms > last and ms - last >= least_ms:
                    rows.append((key[0], ms))
                    last = ms
        state.update((last,))
        if rows:
            yield pd.DataFrame(rows, columns=["key", "ms"])

    return messages.select("key", "ms").groupBy("key").applyInPandasWithState(update, "key long, ms long", "last long", "append", GroupStateTimeout.NoTimeout)
