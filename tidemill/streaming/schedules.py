"""Schedules that fire along a stream's own time.

A schedule waits in state for its next time.  When the watermark has passed it, it fires, and waits
for the time after.  What was due while nothing ran fires once, for the last of those times, unless that is longer ago
than the schedule's grace.

Schedules share buckets by a hash of their key, since each call for a group costs far more than a schedule does.  A bucket's
schedules are one value of state, and its event-time timer is that of the one which is due first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DataType, TimestampType

from ..operators.runs import grace as grace_seconds

#: Firings that leave a task at once.
CHUNK = 100_000
#: Buckets that schedules are dealt to; with another number a stream does not find its state again.
BUCKETS = 1024
_NEVER = np.iinfo(np.int64).max


def due(start: int, every: int, last: int, now: int, end: int) -> tuple[int, int]:
    """How many times (microseconds) of a schedule lie after ``last`` and up to ``now`` and ``end``, and the first of them.  ``every`` 0: only ``start``."""
    upto = min(now, end)
    if every <= 0:
        return (1, start) if last < start <= upto else (0, start)
    first = start if last < start else start + ((last - start) // every + 1) * every
    return (0, first) if first > upto else ((upto - first) // every + 1, first)


#: A schedule in state; next is the time, in milliseconds, at which it is looked at again.
_STATE = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("start", "every", "grace", "end", "last", "next"))])


class _Fires(StatefulProcessor):
    def __init__(self, up_from: int) -> None:
        self.up_from = up_from

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plans = handle.getValueState("plans", "plans binary")

    def _read(self) -> dict[str | None, list[int]]:
        if not self.plans.exists():
            return {}
        table = pa.ipc.open_stream(pa.py_buffer(bytes(self.plans.get()[0]))).read_all()
        return {k: list(x) for k, *x in zip(*(c.to_pylist() for c in table.columns))}

    def _write(self, plans: dict[str | None, list[int]]) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _STATE) as out:
            out.write_table(pa.table([pa.array([*plans], pa.string()), *(pa.array(list(c), pa.int64()) for c in zip(*plans.values()))], schema=_STATE))
        self.plans.update((sink.getvalue().to_pybytes(),))

    def _wait(self, plans: dict[str | None, list[int]]) -> None:
        """The bucket's timer, if it isn't the one that is set."""
        following = min(x[5] for x in plans.values())
        known = list(self.handle.listTimers())
        if following < _NEVER and following not in known:
            self.handle.registerTimer(following)

    def _fired(self, plans: dict[str | None, list[int]], keys: Iterable[str | None], now: int) -> Iterator[pd.DataFrame]:
        """What is due at ``now`` of the schedules of ``keys``, which learn when they are looked at again."""
        found: list[tuple[str | None, Any, bool]] = []
        held = 0
        for key in keys:
            start, every, grace, end, last, _ = plans[key]
            if now < self.up_from:  # nothing runs yet
                plans[key][5] = -(-self.up_from // 1000) if due(start, every, last, _NEVER - every - 1, end)[0] else _NEVER
                continue
            n, first = due(start, every, last, self.up_from, end)
            if n:  # missed: the last of them, once
                at = first + (n - 1) * every
                if now - at <= grace:
                    found.append((key, np.array([at], dtype=np.int64), True))
                    held += 1
            n, first = due(start, every, max(last, self.up_from), now, end)
            for k in range(0, n, CHUNK):
                found.append((key, first + every * np.arange(k, min(n, k + CHUNK), dtype=np.int64), False))
                held += len(found[-1][1])
                if held >= CHUNK:
                    yield _frame(found)
                    found, held = [], 0
            last = max(last, now)
            n, following = due(start, every, last, _NEVER - every - 1, end)
            plans[key][4:] = last, -(-following // 1000) if n else _NEVER  # kept when nothing follows too, so that it isn't taken for a new one
        if found:
            yield _frame(found)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            part = part[part["start"].notna()]
            newest = (part if newest is None else pd.concat([newest, part])).sort_values(["us", "start", "every"]).drop_duplicates("key", keep="last")
        if newest is None or not len(newest):
            return
        plans, changed = self._read(), []
        for k, *new in zip(*(newest[c].tolist() for c in ("key", "start", "every", "grace", "end"))):
            new, old = [int(x) for x in new], plans.get(k)
            if old is None or old[:4] != new:
                plans[k] = [*new, old[4] if old else -_NEVER, _NEVER]
                changed.append(k)
        if changed:
            yield from self._fired(plans, changed, timerValues.getCurrentWatermarkInMs() * 1000)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self._wait(plans)
            self._write(plans)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        plans, now = self._read(), timerValues.getCurrentWatermarkInMs()
        yield from self._fired(plans, [k for k, x in plans.items() if x[5] <= now], now * 1000)
        self._wait(plans)
        self._write(plans)


def _frame(found: list[tuple[str | None, Any, bool]]) -> pd.DataFrame:
    sizes = [len(at) for _, at, _ in found]
    return pd.DataFrame({
        "key": np.repeat(np.array([k for k, _, _ in found], dtype=object), sizes), "us": np.concatenate([at for _, at, _ in found]),
        "missed": np.repeat(np.array([m for _, _, m in found], dtype=bool), sizes),
    })


def _said(key: Column, kind: DataType) -> Column:
    """A key as a text that tells it apart, which Python leaves as it is."""
    return F.unix_micros(key).cast("string") if isinstance(kind, TimestampType) else F.base64(key) if isinstance(kind, BinaryType) else key.cast("string")


def _meant(text: Column, kind: DataType) -> Column:
    return F.timestamp_micros(text.cast("long")) if isinstance(kind, TimestampType) else F.unbase64(text) if isinstance(kind, BinaryType) else text.cast(kind)


def fired(events: DataFrame, key: str, ts: str, start: str, seconds: str, run_if_missed: str, up_from: str, end: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """key, fires_at and missed of the schedules in a stream.  A row with a ``start`` sets the schedule of its key (the newest counts, and a
    changed one goes on from where its key was); one without only moves time on.  ``seconds`` that aren't positive make a single one.

    Times up to ``up_from`` (a timestamp) were missed: of those a key fires the last, if its grace (see
    :func:`tidemill.operators.runs.grace`) isn't over.  All later times fire, though one batch may pass several.  ``delay``: how far the
    watermark stays behind the newest event.  Needs the RocksDB state store, which is set for the session."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    border = spark.range(1).select(F.unix_micros(F.lit(up_from).cast("timestamp"))).first()[0]
    every = F.greatest(F.coalesce(F.col(seconds).cast("long"), F.lit(0)), F.lit(0)) * 1_000_000
    late = grace_seconds(F.when(every > 0, "interval").otherwise("once"), F.col(run_if_missed)).cast("long") * 1_000_000
    last = F.coalesce(F.unix_micros(F.col(end).cast("timestamp")), F.lit(_NEVER)) if end else F.lit(_NEVER)
    kind = events.schema[key].dataType
    rows = events.withWatermark(ts, delay).select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), _said(F.col(key), kind).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.unix_micros(F.col(start).cast("timestamp")).alias("start"), every.alias("every"), late.alias("grace"), last.alias("end"))
    found = rows.groupBy("bucket").transformWithStateInPandas(_Fires(border), "key string, us long, missed boolean", "append", "eventTime")
    return found.select(_meant(F.col("key"), kind).alias("key"), F.timestamp_micros("us").alias("fires_at"), "missed")
