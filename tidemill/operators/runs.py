"""Analytics of runs, schedules and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent
from .ordering import chunked, numbered, previous, previous_in, running, running_in


def micros(ts: Column | str) -> Column:
    """A time as a number of microseconds; times without a zone as they read."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def status_counts(runs: DataFrame, by: str, status: str, names: Sequence[str]) -> DataFrame:
    """``by``, total, and a column for each status."""
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in names))


def mix(runs: DataFrame, task: str, ts: str, now: Column, days: int = 7, n: int = 3) -> DataFrame:
    """The ``n`` most run tasks of the last days, with their share among themselves (halves up)."""
    top = runs.filter((F.col(ts) > now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= now)).groupBy(task).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), task).limit(n)
    return top.withColumn("pct", F.floor(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()) + 0.5).cast("long"))  # a window over n rows


def latest(runs: DataFrame, by: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """The last run of each ``by``; ties by the columns' values."""
    return runs.groupBy(by).agg(F.max(F.struct(ts, *columns)).alias("last")).select(by, "last.*")


def age_days(ts: Column, now: Column) -> Column:
    return F.floor((micros(now) - micros(ts)) / 86_400_000_000).cast("long")


def over_limit(hits: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Each hit with n, the hits of its key in the ``seconds`` up to it, itself included, and blocked (n over the limit)."""
    return within(hits, [key], ts, seconds, F.lit(1), "n", itself=True).withColumn("blocked", F.col("n") > limit)


def within(rows: DataFrame, by: Sequence[str], ts: str, seconds: int, value: Column, name: str, itself: bool) -> DataFrame:
    """``rows`` with the sum of ``value`` over their key's rows in the ``seconds`` up to them, or before them.

    Time is cut into spans of that length; a row's sum reaches into its own span and the one before, so each row
    is also dealt to the next span, and a key of very many rows is split by time."""
    span = seconds * 1_000_000
    timed = rows.withColumns({"_us": micros(ts), "_value": value})
    dealt = timed.withColumn("_span", F.explode(F.array(F.floor(F.col("_us") / span), F.floor(F.col("_us") / span) + 1)))
    w = Window.partitionBy(*by, "_span").orderBy("_us").rangeBetween(-span + 1, 0 if itself else -1)
    summed = dealt.withColumn(name, F.coalesce(F.sum("_value").over(w), F.lit(0)).cast("long"))
    return summed.filter(F.col("_span") == F.floor(F.col("_us") / span)).drop("_us", "_value", "_span")


def blocked_logins(attempts: DataFrame, key: str, ts: str, failed: Column, seconds: int = 300, most: int = 5) -> DataFrame:
    """Each attempt with recent, the failures of its key in the ``seconds`` before it and since its last success, and blocked
    (as many as ``most``)."""
    since = running(attempts, [key], [ts, "attempt"], (~failed).cast("int"), "_epoch")
    since = since.withColumn("_epoch", F.col("_epoch") - (~failed).cast("int"))  # a success ends its own epoch
    return within(since, [key, "_epoch"], ts, seconds, failed.cast("int"), "recent", itself=False).withColumn("blocked", F.col("recent") >= most).drop("_epoch")


def firings(schedules: DataFrame, key: str, start: str, seconds: str, until: Column) -> DataFrame:
    """Every time an interval schedule fires up to ``until``: key, fires_at.  Intervals that aren't positive never fire."""
    ok = schedules.filter((F.col(seconds) > 0) & (F.col(start) <= until))
    each = F.sequence(F.lit(0).cast("long"), F.floor((F.unix_seconds(until) - F.unix_seconds(start)) / F.col(seconds)).cast("long"))
    return ok.select(key, start, seconds, F.explode(each).alias("k")).select(key, F.timestamp_seconds(F.unix_seconds(start) + F.col("k") * F.col(seconds)).alias("fires_at"))


def grace(kind: Column, run_if_missed: Column) -> Column:
    """How late a firing may still run, in seconds: a minute, or if missed ones are to run a week, and 30 days for single ones."""
    return F.when(~F.coalesce(run_if_missed, F.lit(False)), 60).when(kind == "once", 30 * 86400).otherwise(7 * 86400)


# --- logs ---------------------------------------------------------------------------

def log_events(lines: DataFrame, text: str) -> DataFrame:
    """Log lines taken apart: kind (the tag in brackets), done and total of ``3/10``, item, and seconds of ``duration=1.5s``."""
    line = F.col(text)
    number = lambda p, k: F.regexp_extract(line, p, k).try_cast("long")
    progress = r"(?:^|\s)(\d+)/(\d+)(?:\s+(\S+))?"
    return lines.withColumns({
        "kind": F.nullif(F.lower(F.regexp_extract(line, r"^\s*\[([A-Za-z_-]+)\]", 1)), F.lit("")),
        "done": number(progress, 1), "total": number(progress, 2), "item": F.nullif(F.regexp_extract(line, progress, 3), F.lit("")),
        "seconds": F.regexp_extract(line, r"duration=([0-9.]+)s", 1).try_cast("double"),
    })


def log_summary(events: DataFrame, by: str) -> DataFrame:
    """Per log: events of each outcome, the largest total told, and how much of it is done."""
    out = events.groupBy(by).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind") == "ok").alias("ok"), F.count_if(F.col("kind") == "warn").alias("warnings"),
        F.count_if(F.col("kind") == "error").alias("errors"), F.max("total").alias("most"), F.max("done").alias("done"),
    )
    return out.withColumn("pct", percent(F.coalesce("done", F.lit(0)), F.coalesce("most", F.lit(0)), 0))


def sessions(rows: DataFrame, by: str, order: str, mark: Column) -> DataFrame:
    """``rows`` with session, the number of marks seen so far in their ``by``, and the rows before the first mark in session 0."""
    return running(rows, [by], [order], mark.cast("int"), "session").withColumn("session", F.col("session").cast("long"))


def islands(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of equal values: by, island (from 1), value, n, first and last of ``order``."""
    last = previous_in(chunked(rows.select(by, order, value), [by], [order]), [by], [order], value, "_last")
    changed = F.col("_last").isNull() | ~F.col(value).eqNullSafe(F.col("_last.v"))
    marked = running_in(last.withColumn("_new", changed.cast("int")).drop("_last"), [by], [order], "_new", "island").withColumn("island", F.col("island").cast("long"))
    return marked.groupBy(by, "island", value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """``rows`` with batch, from 0, of ``size`` rows of each ``by``."""
    return numbered(rows, [by], [order], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("long"))


def settings(*layers: tuple[str, DataFrame]) -> DataFrame:
    """key, value and source of settings (key, value), of several layers the last one that gives a value that isn't blank."""
    rows = None
    for rank, (name, df) in enumerate(layers):
        own = df.filter("trim(coalesce(value, '')) <> ''").select("key", F.struct(F.lit(rank).alias("rank"), F.col("value"), F.lit(name).alias("source")).alias("s"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("key").agg(F.max("s").alias("s")).select("key", "s.value", "s.source")


# The states that a run may pass to from each state.
TRANSITIONS = {"queued": ["running", "canceled"], "running": ["succeeded", "failed", "canceled"], "succeeded": [], "failed": [], "canceled": []}


def bad_transitions(events: DataFrame, run: str, order: str, status: str, allowed: Mapping[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """run, ``order``, before and after of every change of state that may not be; a state that is told again is no change."""
    last = previous(events.select(run, order, status), [run], [order], status, "_last")
    may = F.lit(False)
    for state, following in allowed.items():
        may = may | ((F.col("_last.v") == state) & F.col(status).isin(list(following)))
    changed = F.col("_last").isNotNull() & ~F.col("_last.v").eqNullSafe(F.col(status))
    return last.filter(changed & ~F.coalesce(may, F.lit(False))).select(run, order, F.col("_last.v").alias("before"), F.col(status).alias("after"))
