"""Decisions that depend on an order of events: one step function for batch and for streams.

A step takes a key's state (a tuple of numbers, or None) and an event's time in milliseconds, and returns
the new state and whether the event is let through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = tuple[int, int, int]
Step = Callable[[State | None, int], tuple[State, bool]]


def anchored_window(limit: int = 10, window_ms: int = 1000) -> Step:
    """Windows begin with the first event after the last one's end; ``limit`` events a window pass."""

    def step(state: State | None, at: int) -> tuple[State, bool]:
        if state is None or at - state[0] >= window_ms:
            return (at, 1, 0), True
        return (state[0], state[1] + 1, 0), state[1] < limit

    return step


def gap_limit(limit: int = 10, gap_ms: int = 60_000, block_ms: int = 900_000) -> Step:
    """A count that a pause of ``gap_ms`` resets; beyond ``limit`` the key is blocked for a while."""

    def step(state: State | None, at: int) -> tuple[State, bool]:
        last, count, blocked = state or (at, 0, 0)
        if at < blocked:
            return (at, count, blocked), False
        count = 1 if at - last > gap_ms or blocked else count + 1
        if count > limit:
            return (at, count, at + block_ms), False
        return (at, count, 0), True

    return step


def decided(events: DataFrame, step: Step, key: str = "key", at_ms: str = "at_ms", order: str = "seq") -> DataFrame:
    """(key, seq, at_ms, allowed) in batch: sorted events stream through tasks, one state at a time."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for frame in frames:
            allowed = []
            for k, at in zip(frame["key"], frame["at_ms"]):
                if k != held:
                    held, state = k, None
                state, ok = step(state, int(at))
                allowed.append(ok)
            yield frame.assign(allowed=allowed)

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("seq"), F.col(at_ms).cast("bigint").alias("at_ms")).filter("key IS NOT NULL AND at_ms IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "at_ms", "seq").mapInPandas(fold, "key string, seq bigint, at_ms bigint, allowed boolean")


def decided_stream(events: DataFrame, step: Step, idle_ms: int | None = None, key: str = "key", at_ms: str = "at_ms", order: str = "seq") -> DataFrame:
    """The same over a stream. A key's state goes when it has been idle for ``idle_ms``.

    With that bound the stream wakes up to let states go, also without data: it must not be run until all is read.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = pd.concat(frames).sort_values(["at_ms", "seq"])
        allowed = []
        for at in rows["at_ms"]:
            now, ok = step(now, int(at))
            allowed.append(ok)
        state.update(tuple(int(x) for x in now))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"], "at_ms": rows["at_ms"], "allowed": allowed})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("seq"), F.col(at_ms).cast("bigint").alias("at_ms"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, seq bigint, at_ms bigint, allowed boolean", "a bigint, b bigint, c bigint", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
