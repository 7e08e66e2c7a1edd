"""Usage, noise and similarity of the names that records are filed under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..functions.text import contains_any, similarity_key

# Phrases that make a name too particular to file under.
NOISY = ["recipe", "how to make", "from scratch", "without drippings", "from drippings"]


def with_usage(names: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``names`` with usage, how many links each has, unused ones too."""
    counted = links.groupBy(key).agg(F.count(F.lit(1)).alias("usage"))
    return names.join(counted, key, "left").withColumn("usage", F.coalesce("usage", F.lit(0).cast("long")))


def noisy(name: Column) -> Column:
    return F.lower(name).rlike("|".join(rf"\b{p}\b" for p in NOISY))


def problems(names: DataFrame, name: str, long_from: int = 24, least_usage: int = 2) -> DataFrame:
    """Names (with usage) that are too long, too rare or noisy: name, usage, reasons; rarest first."""
    reasons = F.array_compact(F.array(
        F.when(F.length(name) >= long_from, "name_too_long"), F.when(F.col("usage") < least_usage, "low_usage"), F.when(noisy(F.col(name)), "noisy_or_over_specific"),
    ))
    return names.select(name, "usage", reasons.alias("reasons")).filter(F.size("reasons") > 0).orderBy("usage", name)


def to_delete(names: DataFrame, name: str, longest: int = 24, least_usage: int = 1, drop_noisy: bool = False, only_unused: bool = False) -> DataFrame:
    """Names that a clean-up would delete: rare ones, and unless only unused ones go, those as long as ``longest`` and noisy ones."""
    gone = F.col("usage") == 0 if only_unused else (F.col("usage") < least_usage) | (F.length(name) >= longest) | (noisy(F.col(name)) & F.lit(drop_noisy))
    return names.filter(gone).select(name, "usage").orderBy("usage", name)


def prompt_candidates(names: DataFrame, name: str, longest: int = 24, least_usage: int = 0) -> DataFrame:
    """Distinct names fit to be offered: not longer than ``longest``, not rarer than ``least_usage``, without a noisy phrase inside."""
    out = (F.length(name) > longest) | (F.col("usage") < least_usage) | contains_any(F.lower(name), NOISY)
    return names.filter(~out & (F.trim(name) != "")).select(F.trim(name).alias("name")).distinct().orderBy("name")


def similar(names: DataFrame, name: str) -> DataFrame:
    """Names that only differ in case and punctuation: key, members (sorted), n; largest groups first."""
    groups = names.filter(F.trim(name) != "").groupBy(similarity_key(F.col(name)).alias("key")).agg(F.array_sort(F.collect_set(F.trim(name))).alias("members"))
    return groups.withColumn("n", F.size("members")).filter("n > 1").orderBy(F.desc("n"), F.col("members")[0])


def top_shares(links: DataFrame, column: str, total: int, n: int = 6) -> DataFrame:
    """The ``n`` most frequent values, ties by value, with how many percent of ``total`` records they are."""
    counted = links.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column).limit(n)
    return counted.withColumn("pct", percent(F.col("count"), F.lit(total), 0).cast("int"))


def filed(records: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """total, and for each check how many records fail it: one row."""
    return records.agg(F.count(F.lit(1)).alias("total"), *(F.coalesce(F.count_if(~F.coalesce(c, F.lit(False))), F.lit(0)).alias(f"without_{k}") for k, c in checks.items()))


def unused(names: DataFrame) -> DataFrame:
    """names and unused: how many names (with usage) there are and how many nothing is filed under."""
    return names.agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("usage") == 0).alias("unused"))


def duplicate_names(items: DataFrame, name: str, index: str) -> DataFrame:
    """Items whose name (whatever its case) an earlier one has, and items without a name: index, error, first_index."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    rows = items.select(F.col(index).alias("index"), key.alias("key"))
    first = rows.filter("key <> ''").groupBy("key").agg(F.min("index").alias("first_index"))
    found = rows.join(first, "key", "left")
    error = F.when(F.col("key") == "", "missing_name").when(F.col("index") > F.col("first_index"), "duplicate_name")
    return found.select("index", error.alias("error"), F.when(F.col("key") != "", F.col("first_index")).alias("first_index")).filter("error IS NOT NULL")
