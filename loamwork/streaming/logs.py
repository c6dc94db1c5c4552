"""Streaming forms of the log operators, for Structured Streaming tables of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_sessions(events: DataFrame, idle: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(scope, start, end, n) of closed sittings; events (scope, ts). A sitting is out once the watermark has passed it."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", idle).alias("w"), "scope")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
        .select("scope", F.col("w.start").alias("start"), "last", "n")
    )


def stream_activation(bumps: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(id, window_end, gain): gains per artifact and window, mergeable into activation by decaying each window's sum from its end."""
    return bumps.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "id").agg(F.sum("gain").alias("gain")).select("id", F.col("w.end").alias("window_end"), "gain")


def stream_coalesced(events: DataFrame, gap: int = 15, late: str = "1 minute") -> DataFrame:
    """Keystroke folding as the events come: (door, scope, id, at, query, pool) of bursts that ended.

    State per (door, scope) is the one pending event. A query that extends it, or is a prefix
    of it, within ``gap`` seconds folds; any other releases it, and so does silence once the watermark is past it.
    """
    schema = "door string, scope string, id long, at long, query string, pool long"

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(pending)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "id"])
            for r in rows.itertuples(index=False):
                now = (int(r.id), int(r.at), str(r.query), int(r.pool), int(r.at))
                if pending is None:
                    pending = now
                    continue
                near = gap > 0 and now[1] - pending[4] <= gap
                extends, prefix = now[2].startswith(pending[2]), pending[2].startswith(now[2])
                if near and (extends or prefix) and not (now[3] == 0 and pending[3] > 0):
                    pending = now if extends else (*pending[:4], now[1])
                else:
                    out.append(pending)
                    pending = now
            state.update(pending)
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (pending[4] + gap + 1) * 1000))
        yield pd.DataFrame([(key[0], key[1], *p[:4]) for p in out], columns=["door", "scope", "id", "at", "query", "pool"])

    timed = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy("door", "scope").applyInPandasWithState(walk, schema, "id long, at long, query string, pool long, last long", "append", GroupStateTimeout.EventTimeTimeout)
