"""Entities to create, look up and delete, and the payloads that say so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import truth
from ..functions.text import collapsed, given, name_key
from .ingest import suspicion


def in_group(records: DataFrame, column: str, group: object | None) -> DataFrame:
    """The records of a group; all of them if none is named."""
    return records if group is None else records.filter(F.col(column) == F.lit(group))


def first_group(groups: DataFrame, key: str) -> DataFrame:
    """The group that counts where none is named: the smallest id, in one row."""
    return groups.agg(F.min(key).alias(key))


def resolved(wanted: DataFrame, existing: DataFrame, name: str, key: str, reserved: DataFrame | None = None) -> DataFrame:
    """name, id and action for each wanted name: existing, create, or review if another table (``reserved``: name) has it already, in
    which case creating it would fail.  Names are equal whatever their case and spaces."""
    each = wanted.select(collapsed(F.col(name)).alias("name")).filter("name <> ''").groupBy(name_key(F.col("name")).alias("k")).agg(F.min("name").alias("name"))
    known = existing.groupBy(name_key(F.col(name)).alias("k")).agg(F.min(key).alias("id"))
    found = each.join(known, "k", "left")
    taken = F.lit(False)
    if reserved is not None:
        found = found.join(reserved.select(name_key(F.col(name)).alias("k"), F.lit(True).alias("taken")).distinct(), "k", "left")
        taken = F.coalesce("taken", F.lit(False))
    return found.select("name", "id", F.when(F.col("id").isNotNull(), "existing").when(taken, "review").otherwise("create").alias("action"))


def slim(entity: Column) -> Column:
    """id and name of an entity (struct<id, name, ...>); null without an id."""
    return F.when(given(entity["id"]), F.struct(F.trim(entity["id"]).alias("id"), F.trim(F.coalesce(entity["name"], F.lit(""))).alias("name")))


def parsed_block(lines: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Parsed ingredients (food and unit entities, note, quantity) with slim entities, without blank ones, and reason: what is odd about them."""
    rows = lines.select(*keep, slim(F.col("food")).alias("food"), slim(F.col("unit")).alias("unit"), F.trim(F.coalesce("note", F.lit(""))).alias("note"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))
    blank = (F.col("note") == "") & (F.col("quantity") == 0) & F.col("food").isNull() & F.col("unit").isNull()
    return rows.filter(~blank).withColumn("reason", suspicion(F.col("note"), F.col("quantity"), F.col("food.name"), F.col("unit.name")))


def payload(required: dict[str, Column], optional: dict[str, Column]) -> Column:
    """A JSON object of the required fields, and of the optional texts that say something."""
    given_only = {k: F.when(given(c), F.trim(c)) for k, c in optional.items()}
    return F.to_json(F.struct(*(c.alias(k) for k, c in (required | given_only).items())))


def cascaded(owners: DataFrame, owned: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the owners in ``gone`` and what they own."""
    names = gone.select(key).distinct()
    return owners.join(names, key, "left_anti"), owned.join(names, key, "left_anti")


def with_column_if_absent(table: DataFrame, column: str, value: Column) -> DataFrame:
    """``table`` with a column that older files of it lack."""
    return table if column in table.columns else table.withColumn(column, value)


def unlinked(links: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Links without those to deleted entities (``gone``: column)."""
    return links.join(gone.select(column).distinct(), column, "left_anti")


def last_value(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The map that assigning one value after another leaves: key and the last value by ``order``."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def unmapped(names: DataFrame, name: str, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct names that are neither canonical (name) nor aliases (alias), in order."""
    known = canonical.select(name_key(F.col("name")).alias("k")).unionByName(aliases.select(name_key(F.col("alias")).alias("k"))).distinct()
    rows = names.filter(given(F.col(name))).select(F.col(name).alias("name"), name_key(F.col(name)).alias("k"))
    return rows.join(known, "k", "left_anti").select("name").distinct().orderBy("name")


# --- saved collections ------------------------------------------------------------

def collections(entries: DataFrame, index: str) -> DataFrame:
    """Entries (name, description, filter, public, position as texts; ``index`` from 1) as typed records with error: null for valid ones.  A
    position that is missing is the index, public is false unless it says otherwise."""
    position = F.when(F.col("position").isNull(), F.col(index)).otherwise(F.trim("position").try_cast("double").cast("int"))
    public = F.when(F.col("public").isNull(), F.lit(False)).otherwise(truth(F.col("public")))
    name = F.trim(F.coalesce("name", F.lit("")))
    error = F.when(name == "", "missing_name").when(public.isNull(), "public_not_boolean").when(position.isNull(), "position_not_integer")
    return entries.select(
        index, name.alias("name"), F.coalesce("description", F.lit("")).alias("description"), collapsed(F.coalesce("filter", F.lit(""))).alias("filter"),
        public.alias("public"), position.cast("int").alias("position"), error.alias("error"),
    )


def collection_plan(existing: DataFrame, desired: DataFrame, replace: bool = False) -> DataFrame:
    """key (the name in lower case), action and id: create, update, skip, and delete or keep for those that aren't desired; missing_id
    where an existing one that should change has no id.  Null, absent and default values are alike."""
    def compared(df: DataFrame) -> Column:
        return F.struct(
            F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("filter", F.lit("")).alias("filter"),
            F.coalesce("public", F.lit(False)).alias("public"), F.coalesce(F.col("position").cast("int"), F.lit(0)).alias("position"),
        )
    key = F.lower(F.trim("name"))
    a = existing.filter(given(F.col("name"))).select(key.alias("key"), F.col("id").alias("id"), compared(existing).alias("old"))
    a = a.groupBy("key").agg(F.max_by(F.struct("id", "old"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("x")).select("key", "x.*")
    b = desired.select(key.alias("key"), compared(desired).alias("new"))
    action = (
        F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete" if replace else "keep")
        .when(F.col("old").eqNullSafe(F.col("new")), "skip").otherwise("update")
    )
    acted = F.when(action.isin("update", "delete") & ~given(F.col("id").cast("string")), "missing_id").otherwise(action)
    return a.join(b, "key", "full_outer").select("key", acted.alias("action"), "id")


def next_position(items: DataFrame, position: str) -> DataFrame:
    """The position after the last: one row."""
    return items.agg((F.coalesce(F.max(position), F.lit(0)) + 1).alias("next"))


def ids_by_name(records: DataFrame, name: str, key: str, order: str) -> DataFrame:
    """name (trimmed, in lower case) and id, of several records with one name the last by ``order``."""
    named = records.filter(given(F.col(name)))
    return named.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.max_by(F.col(key), order).alias("id"))


def lookup(records: DataFrame, wanted: DataFrame, name: str, key: str, group: str) -> DataFrame:
    """name and id for names looked for (group, name) whatever their case, within their group; the smallest id of several, null without any."""
    known = records.groupBy(group, F.lower(F.trim(name)).alias("_k")).agg(F.min(key).alias("id"))
    return wanted.withColumn("_k", F.lower(F.trim("name"))).join(known, [group, "_k"], "left").select(group, "name", "id")
