"""Desired against existing: plans of what to create, update, skip and delete, and merges of two sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import first_by
from .ordering import numbered, rises


def plan(existing: DataFrame, desired: DataFrame, key: str, compare: Sequence[str], replace: bool = False) -> DataFrame:
    """key, action: create (only desired), update or skip (in both, by the compared columns, null-safe), and delete or
    keep (only existing).  Keys are unique in both."""
    a = existing.select(F.col(key), F.struct(*compare).alias("old"))
    b = desired.select(F.col(key), F.struct(*compare).alias("new"))
    only_old, only_new = F.col("new").isNull(), F.col("old").isNull()
    action = F.when(only_new, "create").when(only_old, "delete" if replace else "keep").when(F.col("old").eqNullSafe(F.col("new")), "skip").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def to_create(existing: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    return desired.join(existing.select(key).distinct(), key, "left_anti")


def shared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left`` whose key is in ``right`` too."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def difference(before: DataFrame, after: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """Rows added, removed and changed, the k-th of a key matched with the k-th: key, occurrence, change.

    Occurrences are numbered by the compared columns, so that the same rows meet in any order."""
    def occurrences(df: DataFrame, name: str) -> DataFrame:
        return numbered(df.select(key, *compare), [key], list(compare), "occurrence").select(key, F.col("occurrence").cast("int").alias("occurrence"), F.struct(*compare).alias(name))

    both = occurrences(before, "old").join(occurrences(after, "new"), [key, "occurrence"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return both.select(key, "occurrence", change.alias("change")).filter("change IS NOT NULL")


def order_changed(before: DataFrame, after: DataFrame, key: str, position: str) -> DataFrame:
    """Whether keys in both stand in another order: one row, changed.

    The order is the same if, along the old positions of the shared keys, the new ones never fall."""
    shared = before.select(key, F.col(position).alias("p")).join(after.select(key, F.col(position).alias("q")), key)
    return rises(shared, "p", "q").select((~F.col("rises")).alias("changed"))


def upserted(table: DataFrame, changes: DataFrame, by: Sequence[str], order: str, overwrite: bool = True) -> DataFrame:
    """``table`` with ``changes``: of the rows of a key the newest by ``order`` stays, or the oldest if nothing is to be overwritten."""
    rows = table.unionByName(changes, allowMissingColumns=True)
    return first_by(rows, by, F.struct(order), last=overwrite)


def patched(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``table`` with the columns that a change gives; null ones keep the old value."""
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = table.join(new, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def merged(existing: DataFrame, incoming: DataFrame, key: str, fill: Sequence[str] = (), either: Sequence[str] = (), union: Sequence[str] = ()) -> DataFrame:
    """Both sides as one: ``fill`` columns take the incoming value where the existing one is blank, ``either`` columns are
    true if either is, ``union`` columns are both lists without repeats; other columns are the existing one's, or
    the incoming one's for new keys."""
    def one(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == key:
            return F.coalesce(a, b).alias(c)
        if c in fill:
            return F.when(F.trim(F.coalesce(a, F.lit(""))) != "", a).otherwise(b).alias(c)
        if c in either:
            return (F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))).alias(c)
        if c in union:
            none = F.array().cast("array<string>")
            return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))).alias(c)
        return F.when(F.col(f"a.{key}").isNull(), b).otherwise(a).alias(c)

    joined = existing.alias("a").join(incoming.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(*(one(c) for c in existing.columns))


def linked_once(links: DataFrame, more: DataFrame) -> DataFrame:
    """Links and new ones, none twice."""
    return links.unionByName(more).distinct()


def positions(items: DataFrame, name: str, position: str) -> DataFrame:
    """``items`` with new_position 1..n by position and name; those without a position last."""
    return numbered(items, [], [F.asc_nulls_last(position), F.asc(name)], "new_position")


def repaired_slugs(records: DataFrame, key: str, slug: str, expected: str) -> DataFrame:
    """Records whose slug isn't the expected one, and whether they can have it: key, old_slug, new_slug, action
    (rename, or conflict if another record has the slug or asks for it with a smaller key)."""
    wrong = records.filter((F.col(expected) != "") & (F.col(expected) != F.col(slug))).select(key, F.col(slug).alias("old_slug"), F.col(expected).alias("new_slug"))
    first = wrong.groupBy("new_slug").agg(F.min(key).alias("winner"))
    taken = records.select(F.col(slug).alias("new_slug"), F.lit(True).alias("taken")).distinct()
    found = wrong.join(first, "new_slug").join(taken, "new_slug", "left")
    return found.select(key, "old_slug", "new_slug", F.when((F.col("winner") == F.col(key)) & F.col("taken").isNull(), "rename").otherwise("conflict").alias("action"))


def resource_counts(draft: DataFrame, managed: DataFrame, by: str, key: str, compare: Sequence[str]) -> DataFrame:
    """by, draft, managed and changed for each resource: how many entries either side has, and how many keys differ or are on one side only."""
    a = draft.select(by, key, F.struct(*compare).alias("new"))
    b = managed.select(by, key, F.struct(*compare).alias("old"))
    both = a.join(b, [by, key], "full_outer")
    return both.groupBy(by).agg(
        F.count("new").alias("draft"), F.count("old").alias("managed"), F.count_if(~F.col("new").eqNullSafe(F.col("old"))).alias("changed"),
    )


def dirty(left: DataFrame, right: DataFrame, by: str, order: str, columns: Sequence[str]) -> DataFrame:
    """by and dirty for each resource: whether its entries, in their order, differ in any way.  Entries are hashed with their places, and the hashes
    added up, so that a large resource isn't gathered."""
    def told(df: DataFrame, name: str) -> DataFrame:
        placed = numbered(df.select(by, order, *columns), [by], [order], "_n")
        mark = F.xxhash64(F.to_json(F.struct("_n", *columns), {"ignoreNullFields": "false"}))
        return placed.groupBy(by).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(mark.cast("decimal(20,0)")).alias("h")).alias(name))

    both = told(left, "_a").join(told(right, "_b"), by, "full_outer")
    return both.select(by, (~F.col("_a").eqNullSafe(F.col("_b"))).alias("dirty"))
