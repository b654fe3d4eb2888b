"""Keyed state over streams: the streaming twins of the batch operators in ``operators.ordered``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def anchored_rate_limit(hits: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """``key, at, ok, retry`` of each hit (``at`` in seconds): a bucket starts at its first hit, the hit
    that finds it over starts the next, and refused hits count.  Hits of a key are taken in order of
    time within a batch."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reset, n = state.get if state.exists else (None, 0)
        times = sorted(int(t) for f in frames for t in f["at"])
        rows = []
        for t in times:
            if reset is None or reset <= t:
                reset, n = t + seconds, 0
            n += 1
            rows.append((group[0], t, n <= most, None if n <= most else max(1, reset - t)))
        state.update((reset, n))
        yield pd.DataFrame(rows, columns=[key, "at", "ok", "retry"])

    kind = dict(hits.dtypes)[key]
    return hits.select(key, "at").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at long, ok boolean, retry long", "reset long, n long", "append", GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame, key: str, minutes: int = 60) -> DataFrame:
    """``key, state, attempts, expired``: the last state of each job in order of time (column ``at``, a
    timestamp with a watermark); a job without news for ``minutes`` expires and is forgotten."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            name, attempts = state.get
            state.remove()
            yield pd.DataFrame([(group[0], name, attempts, True)], columns=[key, "state", "attempts", "expired"])
            return
        name, attempts = state.get if state.exists else ("PENDING", 0)
        last = None
        for f in frames:
            f = f.sort_values("at", kind="stable")
            attempts += len(f)
            name, last = f["state"].iloc[-1], f["at"].iloc[-1]
        state.update((name, attempts))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + minutes * 60_000)
        yield pd.DataFrame([(group[0], name, attempts, False)], columns=[key, "state", "attempts", "expired"])

    kind = dict(events.dtypes)[key]
    return events.select(key, "state", "at").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, attempts long, expired boolean", "state string, attempts long", "update", GroupStateTimeout.EventTimeTimeout)


def failure_latch(events: DataFrame, key: str, limit: int) -> DataFrame:
    """``key, failures, latched``: failures since the last success; latches at ``limit``, clears on success."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for f in frames:
            for ok in f.sort_values("at", kind="stable")["ok"]:
                n = 0 if ok else n + 1
        state.update((n,))
        yield pd.DataFrame([(group[0], n, n >= limit)], columns=[key, "failures", "latched"])

    kind = dict(events.dtypes)[key]
    return events.select(key, "ok", "at").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, failures long, latched boolean", "n long", "update", GroupStateTimeout.NoTimeout)


def first_seen(rows: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose keys weren't seen within the watermark: journal resume and ledger dedup on a stream."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, at: str, key: str, size: str, delay: str) -> DataFrame:
    return rows.withWatermark(at, delay).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("n"))
