"""Sessions and transition counts of an unbounded event log, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, actor: str, time: str, gap: str, lateness: str) -> DataFrame:
    """actor, start, end and events of each session; events later than `lateness` are late."""
    return events.withWatermark(time, lateness).groupBy(actor, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events")).select(actor, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def transitions(events: DataFrame, actor: str, time: str, action: str, gap_seconds: float, lateness: str) -> DataFrame:
    """actor, from_state, to_state and ts of every step within sessions, each emitted once.

    The state of an actor is its last event; it goes when no event can continue its session. Events of an actor are
    ordered within a batch, and one that comes after a later one was seen is taken to follow it.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for ts, action_ in zip(rows["ts"], rows["action"]):
            now = ts.timestamp()
            if last is not None and now - last[0] <= gap_seconds:
                out.append((key[0], last[1], action_, ts))
            last = (max(now, last[0] if last else now), action_)
        state.update(last)
        state.setTimeoutTimestamp(max(int((last[0] + gap_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["actor", "from_state", "to_state", "ts"])

    rows = events.select(F.col(actor).cast("string").alias("actor"), F.col(time).cast("timestamp").alias("ts"), F.col(action).cast("string").alias("action")).where("ts is not null and action is not null")
    return rows.withWatermark("ts", lateness).groupBy("actor").applyInPandasWithState(run, "actor string, from_state string, to_state string, ts timestamp", "at double, action string", "append", GroupStateTimeout.EventTimeTimeout)
