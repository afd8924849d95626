"""Upload sessions as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session string, received long, ranges array<struct<start:bigint,stop:bigint>>, state string"
_STATE = "starts array<bigint>, stops array<bigint>, size long, last long"


def add_range(starts: list[int], stops: list[int], start: int, stop: int) -> tuple[list[int], list[int]]:
    """Insert a half-open range into sorted disjoint ones, joining what overlaps or touches."""
    if start < 0 or stop <= start:
        return starts, stops
    out: list[tuple[int, int]] = []
    for a, b in zip(starts, stops):
        if b < start or a > stop:
            out.append((a, b))
        else:
            start, stop = min(a, start), max(b, stop)
    out = sorted([*out, (start, stop)])
    return [a for a, _ in out], [b for _, b in out]


def deduplicated_parts(parts: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Parts without retries: the first of equal (session, start, stop) within the watermark."""
    return parts.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["session", "start", "stop"])


def valid_parts(parts: DataFrame) -> DataFrame:
    """Parts inside their session's size and, where they carry data and sha256, with the right hash."""
    good = (F.col("start") >= 0) & (F.col("stop") > F.col("start")) & ((F.col("size") <= 0) | (F.col("stop") <= F.col("size")))
    if {"data", "sha256"} <= set(parts.columns):
        right = F.coalesce(F.nullif(F.lower("sha256"), F.lit("")) == F.sha2("data", 256), F.lit(True))
        good &= right & F.coalesce(F.octet_length("data") == F.col("stop") - F.col("start"), F.lit(True))
    return parts.where(good)


def session_progress(parts: DataFrame, idle: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Progress of sessions from a stream of parts (session, start, stop, size, ts, and optionally data and sha256).

    Parts out of bounds or with a wrong checksum are dropped first. The state of a session is its
    merged ranges, so it grows with gaps and not with parts, and it survives restarts with the
    checkpoint. A row is given after each batch that touched a session, with state ``open`` or
    ``complete``; complete sessions are forgotten. A session whose last part is ``idle`` behind the
    watermark is reaped with state ``expired``; time is that of the parts, so a replay gives the same.
    """
    span = parts.sparkSession.range(1).select(F.expr(f"CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {idle}) - unix_millis(TIMESTAMP '1970-01-01 00:00:00') AS BIGINT)")).first()[0]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, stops, size, last = state.get if state.exists else ([], [], 0, 0)
        starts, stops = list(starts), list(stops)
        if state.hasTimedOut:
            state.remove()
            label = "expired"
        else:
            for f in frames:
                for a, b, n, ms in zip(f["start"].tolist(), f["stop"].tolist(), f["size"].tolist(), f["__ms"].tolist()):
                    starts, stops = add_range(starts, stops, a, b)
                    size, last = max(size, n), max(last, ms)
            done = len(starts) == 1 and starts[0] == 0 and stops[0] == size
            label = "complete" if done else "open"
            if done:
                if state.exists:
                    state.remove()
            else:
                state.update((starts, stops, size, last))
                state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
        ranges = [{"start": a, "stop": b} for a, b in zip(starts, stops)]
        yield pd.DataFrame({"session": [key[0]], "received": [sum(stops) - sum(starts)], "ranges": [ranges], "state": [label]})

    timed = valid_parts(parts).withWatermark("ts", lateness).select("session", "start", "stop", "size", "ts", F.unix_millis("ts").alias("__ms"))
    return timed.groupBy("session").applyInPandasWithState(step, OUTPUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
