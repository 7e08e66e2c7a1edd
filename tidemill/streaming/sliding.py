"""Limits over sliding windows of a stream, with state that costs a key its new events only.

A key's events are kept in buckets of a ``PARTS``-th of the window, and an index of the buckets with what each sums
up to.  A batch reads and writes the index and the buckets that its events fall into or whose edge their window cuts; all
buckets between are told by the index.  Buckets that no event can reach any more, given how late one may be, are dropped
with the next batch of their key, or by an event-time timer if none comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PARTS = 32
_HIT = np.dtype([("us", "<i8"), ("attempt", "<i8"), ("failed", "?")])
#: A bucket's number, its failures, whether it has a success, and its failures after the last one.
_SUM = np.dtype([("bucket", "<i8"), ("n", "<i8"), ("cleared", "?"), ("after", "<i8")])


def summed(bucket: int, hits: np.ndarray) -> tuple[int, int, bool, int]:
    """The index entry of a bucket's hits, which are in order."""
    clear = np.flatnonzero(~hits["failed"])
    return bucket, int(hits["failed"].sum()), bool(len(clear)), int(hits["failed"][clear[-1] + 1:].sum()) if len(clear) else int(hits["failed"].sum())


class Buckets:
    """The hits of one key.  ``load`` and ``store`` reach buckets that are kept elsewhere; those once loaded stay at hand."""

    def __init__(self, index: bytes, span: int, load) -> None:
        self.index = {int(r["bucket"]): tuple(r.tolist()) for r in np.frombuffer(index, _SUM)}
        self.span, self.width, self.load = span, -(-span // PARTS), load
        self.at_hand: dict[int, np.ndarray] = {}
        self.changed: set[int] = set()

    def hits(self, bucket: int) -> np.ndarray:
        if bucket not in self.at_hand:
            self.at_hand[bucket] = np.frombuffer(self.load(bucket), _HIT) if bucket in self.index else np.zeros(0, _HIT)
        return self.at_hand[bucket]

    def add(self, new: np.ndarray) -> None:
        """``new``, in order, into their buckets."""
        place = new["us"] // self.width
        for bucket in np.unique(place).tolist():
            rows = np.concatenate([self.hits(bucket), new[place == bucket]])
            self.at_hand[bucket] = rows[np.argsort(rows, order=("us", "attempt"), kind="stable")]
            self.index[bucket] = summed(bucket, self.at_hand[bucket])
            self.changed.add(bucket)

    def count(self, us: int, attempt: int | None) -> int:
        """Failures in the window that ends at ``us``.  With an ``attempt``, only those before ``us`` and since the last success
        before (us, attempt); without, those at ``us`` too, whatever succeeded."""
        low, own = us - self.span + 1, us // self.width
        total = 0
        for bucket in range(own, low // self.width - 1, -1):
            if bucket not in self.index:
                continue
            first = bucket * self.width
            if bucket < own and low <= first:  # whole: the index tells
                _, n, cleared, after = self.index[bucket]
                total += after if cleared and attempt is not None else n
            else:
                rows = self.hits(bucket)
                if attempt is None:
                    total += int(rows["failed"][np.searchsorted(rows["us"], low):np.searchsorted(rows["us"], us, "right")].sum())
                    continue
                rows = rows[(rows["us"] < us) | (rows["us"] == us) & (rows["attempt"] < attempt)]
                clear = np.flatnonzero(~rows["failed"])
                cleared = bool(len(clear))
                rows = rows[clear[-1] + 1:] if cleared else rows
                total += int((rows["failed"] & (rows["us"] >= low) & (rows["us"] < us)).sum())
            if attempt is not None and cleared:
                break
        return total

    def drop_before(self, us: int) -> list[int]:
        """Forgets the buckets that end before ``us``, and gives their numbers."""
        gone = [b for b in self.index if (b + 1) * self.width <= us]
        for bucket in gone:
            del self.index[bucket]
            self.at_hand.pop(bucket, None)
            self.changed.discard(bucket)
        return gone

    def packed(self) -> bytes:
        return np.array(sorted(self.index.values()), _SUM).tobytes()


class _Limiter(StatefulProcessor):
    def __init__(self, span: int, grace: int, clearing: bool) -> None:
        self.span, self.grace, self.clearing = span, grace, clearing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "found binary")
        self.kept = handle.getMapState("buckets", "bucket long", "hits binary")

    def _buckets(self) -> Buckets:
        index = self.index.get() if self.index.exists() else None
        return Buckets(bytes(index[0]) if index else b"", self.span, lambda b: bytes(self.kept.getValue((b,))[0]))

    def _keep(self, found: Buckets, before: set[int], us: int) -> None:
        for bucket in found.drop_before(us):
            if bucket in before:
                self.kept.removeKey((bucket,))
        for bucket in sorted(found.changed):
            self.kept.updateValue((bucket,), (found.at_hand[bucket].tobytes(),))
        if found.index:
            self.index.update((found.packed(),))
        else:
            self.index.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = self._buckets()
        before = set(found.index)
        batch = pd.concat(list(rows))
        new = np.zeros(len(batch), _HIT)
        for c in ("us", "attempt", "failed"):
            new[c] = batch[c].to_numpy()
        new = new[np.argsort(new, order=("us", "attempt"), kind="stable")]
        found.add(new)
        n = [found.count(int(h["us"]), int(h["attempt"]) if self.clearing else None) for h in new]
        newest = max((b + 1) * found.width for b in found.index)
        # The watermark will be behind this key's newest event by the grace at most; what is later than that is not let in.
        self._keep(found, before, max(timerValues.getCurrentWatermarkInMs() * 1000, newest - found.width - self.grace) - self.span + 1)
        self.handle.registerTimer(max((newest + self.span) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": key[0], "us": new["us"], "attempt": new["attempt"], "n": np.array(n, np.int64)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.index.exists():
            found = self._buckets()
            self._keep(found, set(found.index), timerValues.getCurrentWatermarkInMs() * 1000 - self.span + 1)
        return iter(())


def _limited(events: DataFrame, key: str, ts: str, attempt: Column, failed: Column, seconds: int, grace: str, clearing: bool) -> DataFrame:
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    late = spark.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {grace})")).first()[0]
    kind = events.schema[key].dataType.simpleString()
    hits = events.withWatermark(ts, grace).filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.coalesce(attempt.cast("long"), F.lit(0)).alias("attempt"), failed.alias("failed"))
    return hits.groupBy("key").transformWithStateInPandas(_Limiter(seconds * 1_000_000, late, clearing), f"key {kind}, us long, attempt long, n long", "append", "eventTime")


def limiter(events: DataFrame, key: str, ts: str, seconds: int, limit: int, grace: str = "10 minutes") -> DataFrame:
    """key, ts, n and blocked of each event of a stream: n are the hits of its key in the ``seconds`` up to it, itself and others at its
    time included, and blocked those over the limit.

    An event that comes late, by up to ``grace``, counts the hits that were before it, not those after; a later one is
    dropped.  Events without a time are left out; a null key is a key.  Needs the RocksDB state store, which is set for the session."""
    found = _limited(events, key, ts, F.lit(0), F.lit(True), seconds, grace, False)
    return found.select("key", F.timestamp_micros("us").alias("ts"), "n", (F.col("n") > limit).alias("blocked"))


def login_limiter(events: DataFrame, key: str, ts: str, attempt: str, failed: Column, seconds: int = 300, most: int = 5, grace: str = "10 minutes") -> DataFrame:
    """key, ts, attempt, recent and blocked of each attempt of a stream: recent are the failures of its key in the ``seconds`` before it
    and since its last success; blocked are as many as ``most``.  ``attempt`` (an integer) orders what happens at one time.  Late
    events and the rest as told for :func:`limiter`."""
    found = _limited(events, key, ts, F.col(attempt), F.coalesce(failed, F.lit(False)), seconds, grace, True)
    return found.select("key", F.timestamp_micros("us").alias("ts"), "attempt", F.col("n").alias("recent"), (F.col("n") >= most).alias("blocked"))
