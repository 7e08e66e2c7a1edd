"""What a screen shows: settings, options, schedules, progress, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import given
from .ordering import numbered
from .runs import micros

# Fixed value: what stands for a secret.
MASK = "********"


def settings_view(specs: DataFrame, values: DataFrame) -> DataFrame:
    """key, label, group, value, source and has_value of every setting; a secret's value is masked, an unset one is its default."""
    joined = specs.join(values.select("key", F.col("value").alias("_v"), F.col("source").alias("_s")), "key", "left")
    has = given(F.col("_v"))
    shown = F.when(F.col("secret"), F.when(has, MASK).otherwise("")).when(has, F.col("_v")).otherwise(F.coalesce("default", F.lit("")))
    source = F.when(has, F.col("_s")).when(given(F.col("default")), "default").otherwise("unset")
    return joined.select("key", "label", "group", shown.alias("value"), source.alias("source"), has.alias("has_value"))


def with_policy(tasks: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """``tasks`` with allowed: what their policy says, and no where they have none."""
    return tasks.join(policies.select(key, F.col("allow").alias("_a")), key, "left").withColumn("allowed", F.coalesce("_a", F.lit(False))).drop("_a")


def visible(options: DataFrame, conditions: str, values: str) -> DataFrame:
    """Options that none of their conditions (array<struct<key, value>>) hides, by what is chosen (map)."""
    hidden = F.exists(F.coalesce(conditions, F.array().cast("array<struct<key:string,value:string>>")), lambda c: F.coalesce(F.element_at(F.col(values), c["key"]) == c["value"], F.lit(False)))
    return options.filter(~hidden)


def best_config(found: DataFrame, path: str, key: str, value: str, order: str) -> DataFrame:
    """Of several configurations' settings the one with most keys, the first on ties: path, n."""
    counted = found.filter(given(F.col(value))).groupBy(path).agg(F.count_distinct(key).alias("n"), F.min(order).alias("_o"))
    return counted.orderBy(F.desc("n"), "_o").limit(1).select(path, "n")


def totals(live: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Counts as the service tells them, else as counted here, else 0."""
    joined = live.select(key, F.col("n").alias("_a")).join(local.select(key, F.col("n").alias("_b")), key, "full_outer")
    return joined.select(key, F.coalesce("_a", "_b", F.lit(0).cast("long")).alias("n"))


def grouped(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """group, place and names (in order) of rows by group; groups in the given order, others after them."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("names")).select(group, F.when(place > 0, place).otherwise(99).cast("int").alias("place"), "names")


# --- schedules ----------------------------------------------------------------------

def next_runs(schedules: DataFrame, key: str, start: str, seconds: str, end: str, now: Column) -> DataFrame:
    """key and next_run_at: when an interval schedule fires next after ``now``, or a single one (no seconds) fires at all; null after the end."""
    begun = F.floor((micros(now) - micros(start)) / 1_000_000 / F.nullif(F.col(seconds), F.lit(0))) + 1
    k = F.greatest(F.lit(0), begun)
    at = F.when(F.col(seconds) > 0, F.timestamp_micros(F.unix_micros(F.col(start).cast("timestamp")) + (k * F.col(seconds)).cast("long") * 1_000_000)).when(F.col(seconds).isNull() & (F.col(start) > now), F.col(start).cast("timestamp"))
    return schedules.select(key, F.when(F.col(end).isNull() | (at <= F.col(end).cast("timestamp")), at).alias("next_run_at"))


def with_next(schedules: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Schedules with the next run of their job; null for those without one."""
    return schedules.join(jobs.select(key, "next_run_at"), key, "left")


def upcoming(schedules: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """n: how many schedules run within the next hours."""
    at = F.col("next_run_at")
    return schedules.agg(F.count_if((at >= now) & (at <= now + F.expr(f"INTERVAL {hours} HOURS"))).alias("n"))


def soonest(schedules: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The ``n`` schedules that run next."""
    return schedules.filter("next_run_at IS NOT NULL").orderBy("next_run_at", key).limit(n).select(key, "next_run_at")


def coalesced(firings: DataFrame, key: str, at: str, up_from: Column, now: Column, grace: Column) -> DataFrame:
    """Firings that run after a time in which nothing ran (up to ``up_from``): those after it, and of those missed before it one a key, the
    last that isn't older than its grace in seconds."""
    missed = firings.filter((F.col(at) <= up_from) & (micros(now) - micros(at) <= grace.cast("long") * 1_000_000)).groupBy(key).agg(F.max(at).alias(at)).withColumn("missed", F.lit(True))
    return firings.filter(F.col(at) > up_from).select(key, at, F.lit(False).alias("missed")).unionByName(missed.select(key, at, "missed"))


# --- progress -----------------------------------------------------------------------

def progress(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with idx, total and mark: whether a line tells of it, at each quarter of all and at the end."""
    n = rows.count()
    quarter = max(1, n // 4)
    idx = F.col("idx")
    return numbered(rows, [], list(order), "idx").withColumns({"total": F.lit(n).cast("long"), "mark": (idx % quarter == 0) | (idx == n)})


# Fixed form: the line that progress is told by.
def rate(done: Column, total: Column, seconds: Column) -> Column:
    """``3/10 (0.50/s) ETA: 0.2 min``; inf without anything done."""
    per = F.try_divide(done.cast("double"), F.greatest(seconds, F.lit(1e-9)))
    left = F.greatest(total - done, F.lit(0)).cast("double") / per / 60
    eta = F.when(per > 0, F.format_string("%.1f", left)).otherwise("inf")
    return F.concat(done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), F.format_string("%.2f", per.cast("double")), F.lit("/s) ETA: "), eta, F.lit(" min"))


def backoff(attempt: Column, base: float, most: float, jitter: Column) -> Column:
    """Seconds to wait before a retry: doubled with each attempt (from 0), at most ``most``, and a share (0 to 1) of ``base`` more."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt)) + jitter * base


def stamp(ts: Column) -> Column:
    """``20240131T235959Z``, as names of files carry it."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ran_for(started: Column, finished: Column, now: Column) -> Column:
    """Seconds that a run took, or has taken so far; null if it hasn't begun."""
    return (micros(F.coalesce(finished, now)) - micros(started)) / 1_000_000


def samples(changes: DataFrame, by: Sequence[str], name: str, n: int = 8) -> DataFrame:
    """by, n and sample: how many changes there are and the first ``n`` distinct names, combined in the map tasks."""
    from .dedup import newest

    first = newest(changes.select(*by, name).distinct().withColumn("_by", F.struct(*by)), "_by", F.col(name), n)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(name)).alias("sample"))
    return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(listed, list(by))


def status_summary(rows: DataFrame, status: str, names: Sequence[str]) -> DataFrame:
    """One row: total, and how many rows have each status."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in names))


def label(status: Column, labels: dict[str, str]) -> Column:
    """A status as people read it: its label, or itself with spaces and a capital."""
    known = F.coalesce(*(F.when(status == k, F.lit(v)) for k, v in labels.items()))
    plain = F.translate(status, "_-", "  ")
    return F.coalesce(known, F.concat(F.upper(F.left(plain, F.lit(1))), F.substr(plain, F.lit(2))))
