"""Groups of records under one key, whom to keep, merge plans and their application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matching_ratio, numeric_suffix
from .ordering import running


def usage(links: DataFrame, key: str) -> DataFrame:
    """How many links each value of ``key`` has: key, usage."""
    return links.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("usage"))


def nested_usage(records: DataFrame, arrays: Sequence[Column], name: str) -> DataFrame:
    """How often each id stands in any of several arrays of the records: ``name``, usage."""
    none = F.array().cast("array<string>")
    every = F.concat(*(F.coalesce(a, none) for a in arrays))
    return records.select(F.explode(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != "")).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("usage"))


def capped(plan: DataFrame, order: Sequence[str], succeeded: Column, most: int) -> DataFrame:
    """The first actions of a plan until ``most`` have succeeded; those that fail don't count."""
    done = running(plan.withColumn("_ok", succeeded.cast("int")).withColumn("_all", F.lit(0)), ["_all"], list(order), F.col("_ok"), "_done")
    return done.filter(F.col("_done") - F.col("_ok") < most).drop("_ok", "_all", "_done")


def duplicates(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows whose ``by`` columns, all given, are shared by several rows, with n, their number.  The groups are counted
    with partial sums and joined back, so that a key of very many rows isn't gathered in one task."""
    full = records.filter(" AND ".join(f"`{c}` IS NOT NULL AND CAST(`{c}` AS STRING) <> ''" for c in by))
    groups = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return full.join(groups, list(by))


def keepers(records: DataFrame, by: Sequence[str], best: Sequence[Column], key: str) -> DataFrame:
    """For every group of duplicates its keeper (the first by ``best``, then ``key``) and the others: ``by``..., key, keeper, kept, n.

    A group's best row is a minimum over structs, which map tasks combine; no group is sorted."""
    rows = duplicates(records, by)
    rank = F.struct(*(c.alias(f"r{i}") for i, c in enumerate(best)), F.col(key).alias("key"))
    first = rows.groupBy(*by).agg(F.min(rank).alias("first")).select(*by, F.col("first.key").alias("keeper"))
    return rows.join(first, list(by)).withColumn("kept", F.col(key) == F.col("keeper"))


def name_rank(name: str, slug: str) -> list[Column]:
    """Names without a copy's number first, then longer names, then longer slugs."""
    return [numeric_suffix(F.col(name)).cast("int"), -F.length(F.coalesce(name, F.lit(""))), -F.length(F.coalesce(slug, F.lit("")))]


def merge_plan(records: DataFrame, by: Sequence[str], key: str, name: str, counts: DataFrame | None = None) -> DataFrame:
    """What to merge into what: ``by``..., source_id, source_name, target_id, target_name, source_usage, target_usage.

    The target of a group is its most used record (``counts``: key, usage), ties and groups without counts by the smallest key."""
    rows = records.select(*by, key, name)
    rows = rows.join(counts, key, "left") if counts is not None else rows.withColumn("usage", F.lit(0).cast("long"))
    rows = rows.withColumn("usage", F.coalesce("usage", F.lit(0).cast("long")))
    groups = rows.filter(" AND ".join(f"`{c}` IS NOT NULL AND CAST(`{c}` AS STRING) <> ''" for c in by)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct((-F.col("usage")).alias("rank"), F.col(key).alias("id"), F.col(name).alias("name"))).alias("t"),
    ).filter("n > 1")
    return rows.join(groups, list(by)).filter(F.col(key) != F.col("t.id")).select(
        *by, F.col(key).alias("source_id"), F.col(name).alias("source_name"), F.col("t.id").alias("target_id"), F.col("t.name").alias("target_name"),
        F.col("usage").alias("source_usage"), (-F.col("t.rank")).alias("target_usage"),
    )


def alias_plan(records: DataFrame, aliases: DataFrame, key: str, name_key: str, by_name: DataFrame) -> DataFrame:
    """Merges that an alias table (alias, canonical: keys of names) asks for, and those of equal names (``by_name``:
    source_id, target_id); of a source in both, the alias's: source_id, target_id, reason."""
    ids = records.groupBy(name_key).agg(F.min(key).alias("id"))
    named = aliases.join(ids.withColumnRenamed(name_key, "canonical").withColumnRenamed("id", "target_id"), "canonical")
    from_alias = records.join(named, F.col(name_key) == F.col("alias")).filter(F.col(key) != F.col("target_id")).select(F.col(key).alias("source_id"), "target_id", F.lit("alias_map").alias("reason"))
    both = from_alias.unionByName(by_name.select("source_id", "target_id", F.lit("same_name").alias("reason")))
    best = F.min_by(F.struct("target_id", "reason"), F.struct((F.col("reason") != "alias_map").alias("later"), F.col("target_id").alias("id")))
    return both.groupBy("source_id").agg(best.alias("b")).select("source_id", "b.target_id", "b.reason")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases of several canonical names: alias, canonicals."""
    return aliases.groupBy("alias").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals")).filter(F.size("canonicals") > 1)


def rewritten(links: DataFrame, plan: DataFrame, column: str) -> DataFrame:
    """``links`` with every merged id in ``column`` replaced by its target."""
    to = plan.select(F.col("source_id").alias(column), "target_id")
    return links.join(to, column, "left").withColumn(column, F.coalesce("target_id", column)).drop("target_id")


def without(records: DataFrame, plan: DataFrame, key: str, column: str = "source_id") -> DataFrame:
    """``records`` less those that a plan removes."""
    return records.join(plan.select(F.col(column).alias(key)).distinct(), key, "left_anti")


def similar_names(records: DataFrame, group: str, key: str, name: str, least: float = 0.92) -> DataFrame:
    """Pairs of different names of a group whose matching ratio is ``least`` or more: group, a, b, similarity, one row for each
    pair of names (a < b), with the smallest keys that have them (a_key, b_key).

    If 2m / (la + lb) >= r for m matched characters, turning one name into the other takes at most (1 - r)(la + lb)
    insertions and deletions, each of which touches at most two of a name's pairs of characters.  So of the rarest
    pairs of either name, a few more than that, some one is in both, at places no further apart; names meet by
    those.  Of names that meet, all but so many pairs have to be in both, which is counted before any ratio is.  ``least`` is over 2/3."""
    if least <= 2 / 3:
        raise ValueError("similar names need a ratio over 2/3")
    names = records.filter(F.col(name) != "").groupBy(group, name).agg(F.min(key).alias("k")).select(group, F.col(name).alias("x"), "k", F.length(name).alias("n"))
    edits = F.floor(F.col("n") * (2 * (1 - least) / least)).cast("int")
    wide = least > 0.8  # pairs of characters; below that they might all be touched, and single characters are taken
    size = 2 if wide else 1
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - (size - 1)))
    grams = names.select("*", F.posexplode(F.transform(places, lambda p: F.substr("x", p, F.lit(size)))).alias("at", "gram"))
    # The same pair again in a name is another one, so that names with many of one kind can be told by how many.
    nth = grams.groupBy(group, "x", "k", "n", "gram").agg(F.array_sort(F.collect_list("at")).alias("ats")).select(group, "x", "k", "n", "gram", F.posexplode("ats").alias("nth", "at"))
    common = nth.groupBy(group, "gram", "nth").agg(F.count(F.lit(1)).alias("times"))
    ranked = nth.join(common, [group, "gram", "nth"]).groupBy(group, "x", "k", "n").agg(F.array_sort(F.collect_list(F.struct("times", "gram", "nth", "at"))).alias("all"))
    held = F.transform("all", lambda g: F.xxhash64(g["gram"], g["nth"]))
    rare = ranked.withColumns({"edits": edits, "held": held}).select(group, "x", "k", "n", "edits", "held", F.explode(F.slice("all", F.lit(1), size * F.col("edits") + 1)).alias("_rare"))
    rare = rare.select(group, "x", "k", "n", "edits", "held", "_rare.gram", "_rare.nth", "_rare.at")
    a, b = (rare.select(group, "gram", "nth", *(F.col(c).alias(f"{c}{i}") for c in ("x", "k", "n", "edits", "held", "at"))) for i in (1, 2))
    near = (F.abs(F.col("at1") - F.col("at2")) <= F.greatest("edits1", "edits2")) & (F.least("n1", "n2") * (2 - least) >= F.greatest("n1", "n2") * least)
    most = F.floor((1 - least) * (F.col("n1") + F.col("n2")) + 1e-9)
    enough = F.size(F.array_intersect("held1", "held2")) >= F.greatest("n1", "n2") - (size - 1) - size * most
    pairs = a.join(b, [group, "gram", "nth"]).filter("x1 < x2").filter(near).filter(enough).select(group, F.col("x1").alias("a"), F.col("x2").alias("b"), F.col("k1").alias("a_key"), F.col("k2").alias("b_key")).distinct()
    return pairs.withColumn("ratio", matching_ratio("a", "b")).filter(F.col("ratio") >= least).withColumn("similarity", F.round("ratio", 4)).drop("ratio")


def first_by(rows: DataFrame, by: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in ``order``, combined in the map tasks."""
    kept = F.struct(*(F.col(c) for c in rows.columns))
    best = (F.max_by if last else F.min_by)(kept, order)
    return rows.groupBy(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by))).agg(best.alias("r")).select("r.*")


def newest(rows: DataFrame, by: str, order: Column, n: int) -> DataFrame:
    """The ``n`` newest rows of each key; tasks keep the ``n`` newest of theirs before the shuffle, so a large key is no burden."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("rank") <= n)
