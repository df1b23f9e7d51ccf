"""Operators over unbounded events.

Select, where and shift of ``TStream`` work on streaming frames as they are.
Windows need a watermark; intervals need state per key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hopping(events: DataFrame, time: str, keys: list[str], size: str, hop: str, late: str, **aggregates: Column) -> DataFrame:
    """Aggregates over windows ``(T - size, T]``, emitted once the watermark has passed them.

    ``time`` is a timestamp.  Spark's windows hold their start and not their end,
    so times move back by a microsecond into them.
    """
    moved = events.withColumn("_moved", F.col(time) - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("_moved", late)
    out = moved.groupBy(*keys, F.window("_moved", size, hop).alias("w")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(*keys, F.col("w.start").alias("st"), F.col("w.end").alias("et"), *aggregates)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, within: str, late: str) -> DataFrame:
    """Inner join of two event streams: the right event at most ``within`` before the left one."""
    a = left.withWatermark(time, late).alias("a")
    b = right.withWatermark(time, late).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = (F.col(f"b.{time}") <= F.col(f"a.{time}")) & (F.col(f"b.{time}") >= F.col(f"a.{time}") - F.expr(f"INTERVAL {within}"))
    condition = near
    for c in same:
        condition = condition & c
    kept = [F.col(f"b.{c}").alias(f"r_{c}") for c in right.columns if c not in keys]
    return a.join(b, condition, "inner").select("a.*", *kept)


def live_intervals(events: DataFrame, time: str, key: str, value: str, start: int, idle: int | None = None, watermark: tuple[str, str] | None = None, keep_late: bool = False) -> DataFrame:
    """``(key, st, et, value)`` of events in the order of arrival: each holds from the key's previous event on.

    ``time`` is a long.  The state of a key is its last time.  With ``idle`` (in
    units of ``time``) an event holds for that long at most.  With ``watermark``
    too, a timestamp column and the lateness it allows, a key's state goes once
    the watermark has passed its last event by ``idle`` microseconds: no result
    depends on it any more.  Without either, states stay.

    An event that is not later than the key's last has no interval; with
    ``keep_late`` it gives a row without ``st``.
    """
    if watermark and idle is None:
        raise ValueError("a watermark needs idle, so that results don't depend on when a state goes")
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"`{key}` {kinds[key]}, st long, et long, `{value}` {kinds[value]}"
    columns = [time, key, value]
    if watermark:
        events = events.withWatermark(*watermark)
        columns.append(watermark[0])

    def step(own: tuple, frames: Iterator, state: GroupState):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else start
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        et = rows[time].to_numpy(np.int64)
        before = np.maximum.accumulate(np.r_[last, et])[:-1]
        st, held = before if idle is None else np.maximum(before, et - idle), et > before
        out = pd.DataFrame({key: [own[0]] * len(rows), "st": pd.array(np.where(held, st, 0), "Int64"), "et": et, value: rows[value].to_numpy()})
        out.loc[~held, "st"] = pd.NA
        last = max(last, int(et[-1]))
        state.update((last,))
        if watermark:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (int(rows[watermark[0]].max().value // 1000) + idle) // 1000 + 1))
        out = out if keep_late else out[held]
        if len(out):
            yield out

    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return events.select(*columns).groupBy(key).applyInPandasWithState(step, schema, "last long", "append", timeout)
