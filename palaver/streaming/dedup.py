"""Duplicates and contradictions on a stream, with the batch rule per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _quarantine(expire_ms: int | None):
    """Per key: its first hash and whether another one was seen. Three fields, however many rows.

    States travel to the workers and back in Arrow batches of many keys, not one call at a time.
    """
    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        digest, conflict, n = state.get if state.exists else (None, False, 0)
        before = (digest, conflict)
        latest = 0
        for part in rows:
            n += len(part)
            hashes = part["digest"]
            if expire_ms is not None:
                latest = max(latest, int(part["event_ms"].max()))
            if digest is None:
                hashes = part.sort_values(["event_ms", "digest"])["digest"]
                digest = hashes.iloc[0]
            conflict = bool(conflict or (hashes != digest).any())
        state.update((digest, conflict, n))
        if expire_ms is not None:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + expire_ms)
        if (digest, conflict) != before:
            yield pd.DataFrame({"key": [key[0]], "digest": [digest], "conflict": [conflict], "n": [n]})
    return run


STATE = "digest string, conflict boolean, n bigint"
OUTPUT = "key string, digest string, conflict boolean, n bigint"


def stream_dedup_quarantine(stream: DataFrame, key: str, digest: str, ts: str, delay: str = "10 minutes",
                            expire_ms: int | None = None) -> DataFrame:
    """A changelog of (key, digest, conflict, n): a row when a key appears or turns contradictory.

    The last row of a key is what ``dedup_quarantine`` says about it. Nothing is forgotten by default: state is
    three fields a key, and no row is too late. With ``expire_ms`` state is dropped that long after the last row of a key has
    passed the watermark; then a later contradiction is not seen and rows behind the watermark (``delay``) are left out.
    """
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if expire_ms is not None:
        rows = rows.withWatermark(ts, delay)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(digest).alias("digest"), F.col(ts), F.unix_millis(ts).alias("event_ms"))
    return rows.groupBy("key").applyInPandasWithState(
        _quarantine(expire_ms), OUTPUT, STATE, "update",
        GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.EventTimeTimeout)


def split_late(batch: DataFrame, ts: str, watermark_ms: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch, so that late rows can be kept in a table of their own."""
    late = F.unix_millis(ts) < watermark_ms
    return batch.filter(~late), batch.filter(late)
