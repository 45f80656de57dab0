"""Per-user limits: a sliding log of admitted requests, in batch and as a stream, and a throttle.

A rejected request does not count, so the next decision needs the state after the last one:
rows are brought together by user and sorted, then folded batch by batch with a state of at
most ``limit`` moments. In batch a user's rows pass through one task as a sorted stream; they are
never held together, so a user with very many rows costs time but no memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW_SECONDS = 5, 60.0


class Log:
    """The admitted moments of one user inside the window."""

    __slots__ = ("limit", "moments", "window")

    def __init__(self, limit: int, window: float, moments: list[float] | None = None):
        self.limit, self.window, self.moments = limit, window, deque(moments or [])

    def admit(self, moment: float) -> bool:
        while self.moments and moment - self.moments[0] >= self.window:
            self.moments.popleft()
        if len(self.moments) >= self.limit:
            return False
        self.moments.append(moment)
        return True


def _sorted_by_user(events: DataFrame, user: str, ts: str, event_id: str) -> DataFrame:
    narrow = events.select(F.col(user).alias("u"), F.col(event_id).alias("e"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where("u is not null and us is not null")
    return narrow.repartition("u").sortWithinPartitions("u", "us", "e")


def rate_limit(events: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS, user: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(event_id, user_id, admitted). Events without a user or time are left out; ties go by id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, Log(limit, window)
        for pdf in batches:
            admitted = []
            for u, us in zip(pdf["u"], pdf["us"]):
                if u != current:
                    current, log = u, Log(limit, window)
                admitted.append(log.admit(us / 1e6))
            yield pd.DataFrame({"e": pdf["e"], "u": pdf["u"], "admitted": admitted})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = _sorted_by_user(events, user, ts, event_id).mapInPandas(run, f"e {kinds[event_id]}, u {kinds[user]}, admitted boolean")
    return out.withColumnsRenamed({"e": event_id, "u": user})


def throttle(events: DataFrame, delay: float = 2.0, per_minute: int = 10, user: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(event_id, user_id, scheduled): when each request may go, in seconds since 1970.

    A request waits until ``delay`` after the one before it and a minute after the one
    ``per_minute`` before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, past = None, deque(maxlen=per_minute)
        for pdf in batches:
            times = []
            for u, us in zip(pdf["u"], pdf["us"]):
                if u != current:
                    current, past = u, deque(maxlen=per_minute)
                t = us / 1e6
                if past:
                    t = max(t, past[-1] + delay)
                if len(past) == per_minute:
                    t = max(t, past[0] + 60.0)
                past.append(t)
                times.append(round(t, 6))
            yield pd.DataFrame({"e": pdf["e"], "u": pdf["u"], "scheduled": times})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = _sorted_by_user(events, user, ts, event_id).mapInPandas(run, f"e {kinds[event_id]}, u {kinds[user]}, scheduled double")
    return out.withColumnsRenamed({"e": event_id, "u": user})


def stream_rate_limit(events: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS, user: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """The same over a stream of (user, event id, time): state is the log, dropped when a user is idle for a window.

    Within a micro-batch events are taken in the order of their times, so a user's events of one
    micro-batch are sorted in memory; the source's limit on a micro-batch bounds them.
    """

    def run(key, batches, state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = Log(limit, window, list(state.get[0]) if state.exists else None)
        parts = list(batches)
        pdf = pd.concat(parts, ignore_index=True).sort_values(["us", "e"])
        admitted = [log.admit(us / 1e6) for us in pdf["us"]]
        state.update((list(log.moments),))
        state.setTimeoutDuration(int(window * 1000))
        yield pd.DataFrame({"e": pdf["e"].to_numpy(), "u": pdf["u"].to_numpy(), "admitted": admitted})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    narrow = events.select(F.col(user).alias("u"), F.col(event_id).alias("e"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    out = narrow.groupBy("u").applyInPandasWithState(
        run, f"e {kinds[event_id]}, u {kinds[user]}, admitted boolean", "moments array<double>", "append", "ProcessingTimeTimeout"
    )
    return out.withColumnsRenamed({"e": event_id, "u": user})


def transitions(events: DataFrame, key: list[str], status: str, ts: str) -> DataFrame:
    """Changes of a status in order of time: key, time, before, after, and whether it is a joining or a leaving."""
    from pyspark.sql import Window

    before = F.lag(status).over(Window.partitionBy(*key).orderBy(ts))
    rows = events.select(*key, ts, before.alias("before"), F.col(status).alias("after"))
    changed = rows.where(~F.col("after").eqNullSafe(F.col("before")))
    inside = lambda c: F.coalesce(c.isin("member", "administrator", "creator"), F.lit(False))
    joined = ~inside(F.col("before")) & inside(F.col("after"))
    left = inside(F.col("before")) & ~inside(F.col("after"))
    return changed.withColumn("change", F.when(joined, "joined").when(left, "left").otherwise("other"))
