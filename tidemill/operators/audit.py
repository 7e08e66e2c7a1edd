"""Completeness scores of records, their distribution, gaps and coverage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent


def link_counts(records: DataFrame, key: str, links: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``records`` with, for each name of ``links`` (a link table with the same key, and its other column), how many
    distinct things each record is linked to.  Every link table shrinks to a row a record before it is joined,
    so links don't multiply each other; a table of several links is read and joined once."""
    tables: dict[int, tuple[DataFrame, list[tuple[str, str]]]] = {}
    for name, (table, other) in links.items():
        tables.setdefault(id(table), (table, []))[1].append((name, other))
    for table, named in tables.values():
        counted = table.groupBy(key).agg(*(F.count_distinct(other).alias(name) for name, other in named))
        records = records.join(counted, key, "left").fillna(0, [name for name, _ in named])
    return records


def tier(score: Column) -> Column:
    return F.when(score >= 5, "gold").when(score >= 3, "silver").otherwise("bronze")


def scored(records: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``records`` with score (how many checks hold; one that is null doesn't), tier and missing (names of those that don't, in order)."""
    held = {name: F.coalesce(c, F.lit(False)) for name, c in checks.items()}
    total = sum((c.cast("int") for c in held.values()), F.lit(0))
    missing = F.array_compact(F.array(*(F.when(~c, F.lit(name)) for name, c in held.items())))
    return records.withColumns({f"has_{n}": c for n, c in held.items()} | {"score": total, "tier": tier(total), "missing": missing})


def distribution(scores: DataFrame, most: int) -> DataFrame:
    """score, n and tier for every score from 0 to ``most``, those of no record too."""
    every = scores.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("score"))
    counted = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(counted), "score", "left").select("score", F.coalesce("n", F.lit(0).cast("long")).alias("n"), tier(F.col("score")).alias("tier"))


def coverage(scores: DataFrame, names: list[str]) -> DataFrame:
    """dimension, hits, total, missing and both in percent; one pass over the scores.  Most gaps first, then by name."""
    sums = scores.agg(F.count(F.lit(1)).alias("total"), *(F.coalesce(F.count_if(F.col(f"has_{n}")), F.lit(0)).alias(n) for n in names))
    rows = sums.unpivot(["total"], names, "dimension", "hits")
    return rows.select(
        "dimension", "hits", "total", (F.col("total") - F.col("hits")).alias("missing"),
        percent(F.col("hits"), F.col("total")).alias("pct"), percent(F.col("total") - F.col("hits"), F.col("total")).alias("pct_missing"),
    ).orderBy(F.desc("missing"), "dimension")


def worst(scores: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The ``n`` records of the lowest scores; ties by key."""
    return scores.orderBy("score", key).limit(n)


def almost(scores: DataFrame, key: str, most: int, n: int = 50) -> DataFrame:
    """The first ``n`` records, by key, that miss one check only."""
    return scores.filter(F.col("score") == most - 1).orderBy(key).limit(n)


def sampled(records: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` records, the same ones in every run: those of the smallest hashes of seed and key."""
    return records.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def estimated_missing(sample: DataFrame, present: Column, total: int) -> DataFrame:
    """sampled, present, pct and the number of all ``total`` records that would lack what the sample lacks."""
    return sample.agg(F.count(F.lit(1)).alias("sampled"), F.coalesce(F.count_if(present), F.lit(0)).alias("present")).select(
        "sampled", "present", percent(F.col("present"), F.col("sampled")).alias("pct"),
        F.floor((1 - F.col("present") / F.greatest("sampled", F.lit(1))) * total).cast("long").alias("estimated_missing"),
    )
