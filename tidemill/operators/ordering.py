"""Places in an order, where one key may hold most rows.

Rows are cut into ranges of (key, order), so a large key is spread over several of them.  Each range is numbered or
summed up for itself; what earlier ranges of the same key amount to is a small table, of two rows a range at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

CHUNK, WITHIN = "_chunk", "_within"


def chunked(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``rows`` with the range that each stands in, written once: ranges are sampled, and a second run may cut elsewhere."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c) for c in by), *(F.col(c) if isinstance(c, str) else c for c in order)]
    return written(rows.repartitionByRange(n, *keys).withColumn(CHUNK, F.spark_partition_id()), "chunks")


def before(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """For each key and range (``rows`` from :func:`chunked`) the sum of ``value`` over the key's earlier ranges: by, chunk, _before.
    Only keys of several ranges are told, two rows a range at most."""
    sums = rows.groupBy(*by, CHUNK).agg(F.sum(value).alias("_sum"))
    several = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.sum("_sum").over(several)).filter("_before IS NOT NULL").select(*by, CHUNK, "_before")


def _with_before(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    told = F.broadcast(before(rows, by, value).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(CHUNK).alias("_kc"), "_before"))
    same = F.col(CHUNK) == F.col("_kc")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(told, same, "left").drop("_kc", *(f"_k{i}" for i in range(len(by))))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their key up to them, in ``order``, which tells all rows of a key apart."""
    return running_in(chunked(rows.withColumn(WITHIN, value), by, order), by, order, WITHIN, name).drop(CHUNK, WITHIN)


def running_in(cut: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The same for rows that are cut already, and the sum of a column."""
    w = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = _with_before(cut.withColumn(name, F.sum(value).over(w)), by, F.col(value))
    return summed.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col(name)).drop("_before")


def latest_in(cut: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``cut`` (rows of :func:`chunked`, or with other ranges as ``_chunk``) with the last value that isn't null of the rows of their key up to them."""
    w = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col(value).isNotNull(), F.struct(*order))
    last = cut.groupBy(*by, CHUNK).agg(F.max_by(value, said).alias("_edge"))
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_edge", F.last("_edge", ignorenulls=True).over(earlier)).filter("_edge IS NOT NULL")
    told = F.broadcast(last.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(CHUNK).alias("_kc"), "_edge"))
    same = F.col(CHUNK) == F.col("_kc")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    found = cut.withColumn(name, F.last(value, ignorenulls=True).over(w)).join(told, same, "left")
    return found.withColumn(name, F.coalesce(name, "_edge")).drop("_edge", "_kc", *(f"_k{i}" for i in range(len(by))))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``rows`` with their number, from 1, among the rows of their key (of all, if ``by`` is empty) in ``order``."""
    cut = chunked(rows, by, order)
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    found = _with_before(cut.withColumn(name, F.row_number().over(w)), by, F.lit(1)) if by else _all_numbered(cut.withColumn(name, F.row_number().over(w)))
    return found.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col(name)).cast("long")).drop(CHUNK, "_before")


def _all_numbered(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_kc").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    told = counts.select(F.col(CHUNK).alias("_kc"), "_n").withColumn("_before", F.sum("_n").over(w)).drop("_n")
    return rows.join(F.broadcast(told), F.col(CHUNK) == F.col("_kc"), "left").drop("_kc")


def previous(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``rows`` with the value of the row before in their key, as struct(v): null for a key's first row."""
    return previous_in(chunked(rows, by, order), by, order, value, name).drop(CHUNK)


def previous_in(cut: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The same for rows that are cut already."""
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    one = F.struct(F.col(value).alias("v"))
    last = cut.groupBy(*by, CHUNK).agg(F.max_by(one, F.struct(*order)).alias("_edge"))
    last = last.withColumn("_edge", F.lag("_edge").over(Window.partitionBy(*by).orderBy(CHUNK))).filter("_edge IS NOT NULL")
    told = F.broadcast(last.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(CHUNK).alias("_kc"), "_edge"))
    same = F.col(CHUNK) == F.col("_kc")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    found = cut.withColumn(name, F.lag(one).over(w)).join(told, same, "left")
    return found.withColumn(name, F.coalesce(name, "_edge")).drop("_edge", "_kc", *(f"_k{i}" for i in range(len(by))))


def rises(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Whether ``value`` never falls along ``order``: one row, rises.  Neighbours are compared within ranges, and the ranges' least and
    greatest values with one another."""
    cut = chunked(rows.select(order, value), [], [order, value])
    w = Window.partitionBy(CHUNK).orderBy(order, value)
    inner = cut.withColumn("_fell", F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False)))
    edges = inner.groupBy(CHUNK).agg(F.max("_fell").alias("_fell"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    edge = Window.orderBy(CHUNK)  # one row a range
    told = edges.withColumn("_fell", F.col("_fell") | F.coalesce(F.col("_least") < F.lag("_most").over(edge), F.lit(False)))
    return told.agg((~F.coalesce(F.max("_fell"), F.lit(False))).alias("rises"))
