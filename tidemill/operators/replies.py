"""Filing records by asking a model: prompts, replies, what they say about which record, and what that changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import repaired_json
from ..functions.text import split_names
from ..sources.scratch import written
from .ingest import appended
from .ordering import numbered

#: Prompts and replies that a task holds as Python objects at once.
AT_ONCE = 256
_ENTRY = "slug string, categories string, category string, tags string, tag string, labels string, tools string, tool string"


def prompt_lines(records: DataFrame, key: str, name: str, parts: Column, most: int = 10) -> DataFrame:
    """key and line: a record's name and its first parts, as a prompt lists it."""
    said = F.array_join(F.slice(F.coalesce(parts, F.array().cast("array<string>")), 1, most), ", ")
    return records.select(key, F.concat(F.lit("- "), F.col(key).cast("string"), F.lit(": "), F.coalesce(name, F.lit("")), F.when(said != "", F.concat(F.lit(" | "), said)).otherwise("")).alias("line"))


def prompts(lines: DataFrame, key: str, size: int, instruction: str) -> DataFrame:
    """batch, keys and prompt for every ``size`` lines in the order of their keys; no prompt is longer, and only the last is shorter."""
    cut = numbered(lines, [], [key, "line"], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "line")))
    return cut.groupBy("batch").agg(rows.alias("r")).select("batch", F.transform("r", lambda x: x["k"]).alias("keys"), F.concat(F.lit(instruction + "\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("prompt"))


def choices(names: DataFrame, name: str) -> DataFrame:
    """The names to choose from as a prompt lists them, in order: one row, listing.  For lists that fit a prompt."""
    return names.filter(F.trim(name) != "").select(F.trim(name).alias("n")).distinct().agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("n")))), "\n").alias("listing"))


def instruction(role: str, lists: Mapping[str, str], example: str) -> str:
    """What a prompt asks for: to choose from the lists (field to listing), for all fields or for one, and to answer in JSON like the example."""
    wanted = "\n".join(f"- {field}: only from the list below; an empty list if nothing fits" for field in lists)
    return "\n".join([f"You are a {role}. For each record give", wanted, f"as a JSON array like [{example}] and nothing else.", *(f"\n{field.capitalize()}:\n{listing}" for field, listing in lists.items()), "\nRecords:"])


def asked(rows: DataFrame, ask: Callable[[str], str | None]) -> DataFrame:
    """``rows`` with reply, what ``ask`` gives for prompt: null if it fails, which a retry can tell.  The provider is called
    in the tasks, and only some prompts and their replies are Python objects at a time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", reply string"
    most = AT_ONCE

    def safely(prompt: str) -> str | None:
        try:
            return ask(prompt)
        except Exception:  # a provider's failure is a missing reply
            return None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                b = batch.slice(k, most)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([safely(p) for p in b.column("prompt").to_pylist()], pa.string())], [*b.schema.names, "reply"])

    return rows.mapInArrow(each, schema)


def entries(replies: DataFrame) -> DataFrame:
    """slug, categories, tags and tools that replies give, under any of the names in use, as lists or as text
    between commas; the first entry of a slug counts, of several replies the one that was asked with the smallest key."""
    parsed = replies.select("keys", F.posexplode(F.from_json(repaired_json("reply"), f"array<struct<{_ENTRY.replace(' string', ':string')}>>")).alias("pos", "e"))
    found = parsed.filter("e.slug IS NOT NULL AND trim(e.slug) <> ''")

    def listed(*names: str) -> Column:
        raw = F.coalesce(*(F.col(f"e.{n}") for n in names))
        return F.coalesce(F.from_json(raw, "array<string>"), split_names(raw))

    rows = found.select(
        F.trim("e.slug").alias("slug"), F.struct(F.array_min(F.transform("keys", lambda k: k.cast("string"))).alias("k"), "pos").alias("_o"), listed("categories", "category").alias("categories"),
        listed("tags", "labels", "tag").alias("tags"), listed("tools", "tool").alias("tools"),
    )
    return rows.groupBy("slug").agg(F.min_by(F.struct("categories", "tags", "tools"), "_o").alias("x")).select("slug", "x.*")


def outcome(records: DataFrame, found: DataFrame, key: str = "slug") -> DataFrame:
    """key and status: answered, missing (asked for without an answer) or unknown (answered without being asked for)."""
    a, b = records.select(key, F.lit(1).alias("a")).distinct(), found.select(key, F.lit(1).alias("b")).distinct()
    return a.join(b, key, "full_outer").select(key, F.when(F.col("a").isNull(), "unknown").when(F.col("b").isNull(), "missing").otherwise("answered").alias("status"))


def filed(records: DataFrame, found: DataFrame, allowed: DataFrame, column: str, replace: bool = False) -> DataFrame:
    """slug and the new array of ``column``: the record's own values and the answered ones that are allowed names (in their
    spelling, whatever the case), or those alone if they replace; only records that change."""
    each = found.select("slug", F.posexplode(column).alias("pos", "said")).withColumn("k", F.lower(F.trim("said")))
    names = allowed.select(F.trim("name").alias("name"), F.lower(F.trim("name")).alias("k")).groupBy("k").agg(F.max("name").alias("name"))
    kept = each.join(names, "k").groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("new"))
    have = F.coalesce(F.col(column), F.array().cast("array<string>"))
    out = records.select("slug", column).join(kept, "slug")
    result = F.array_distinct("new") if replace else appended(have, F.col("new"))
    return out.select("slug", result.alias(column), have.alias("_old")).filter(F.col(column) != F.col("_old")).drop("_old")


def answered(records: DataFrame, key: str, name: str, parts: Column, ask: Callable[[str], str | None], instruction: str, size: int = 25, split: Mapping[str, str] | None = None) -> DataFrame:
    """Entries for records: asked for in batches first, one by one where a batch brought none, and where that brings none
    either by a question for each of ``split`` (field to instruction), whose answers are put together.  Replies are
    written, so that no prompt is asked twice."""
    lines = prompt_lines(records, key, name, parts)
    none = F.array().cast("array<string>")
    found = written(entries(asked(prompts(lines, key, size, instruction), ask)).withColumn("rung", F.lit("batch")), "replies")
    rest = lines.join(found.select(F.col("slug").alias(key)), key, "left_anti")
    one_by_one = lambda rows, said: rows.select(F.array(F.col(key)).alias("keys"), F.concat(F.lit(said + "\n"), "line").alias("prompt"))
    single = written(entries(asked(one_by_one(rest, instruction), ask)).withColumn("rung", F.lit("single")), "replies")
    found = found.unionByName(single)
    if split:
        rest = rest.join(single.select(F.col("slug").alias(key)), key, "left_anti")
        parts_told = None
        for field, said in split.items():
            own = entries(asked(one_by_one(rest, said), ask)).select("slug", *(F.col(c) if c == field else none.alias(c) for c in ("categories", "tags", "tools")))
            parts_told = own if parts_told is None else parts_told.unionByName(own)
        joined = parts_told.groupBy("slug").agg(*(F.flatten(F.collect_list(F.coalesce(c, none))).alias(c) for c in ("categories", "tags", "tools")))
        joined = joined.filter(F.size("categories") + F.size("tags") + F.size("tools") > 0).withColumn("rung", F.lit("split"))
        found = found.unionByName(written(joined, "replies"))
    return found


def filled(found: DataFrame, records: DataFrame, key: str, name: str, parts: Column, field: str, ask: Callable[[str], str | None], instruction: str, size: int = 25) -> DataFrame:
    """Entries whose ``field`` (tags or tools) is empty with what a question for it alone brings; others as they are."""
    empty = found.filter(F.size(F.coalesce(field, F.array().cast("array<string>"))) == 0).select(F.col("slug").alias(key))
    lines = prompt_lines(records.join(empty, key, "left_semi"), key, name, parts)
    more = written(entries(asked(prompts(lines, key, size, instruction), ask)).select("slug", F.col(field).alias("_more")), "replies")
    have = F.size(F.coalesce(F.col(field), F.array().cast("array<string>"))) > 0
    return found.join(more, "slug", "left").withColumn(field, F.when(have, F.col(field)).otherwise(F.coalesce("_more", field))).drop("_more")


def targets(records: DataFrame, mode: str, arrays: Mapping[str, Column], replace: bool = False) -> DataFrame:
    """Records to file: all of them if what they have is to be replaced, else those whose arrays are empty: ``mode`` is missing-categories,
    missing-tags, missing-tools, or missing-either for any of them."""
    if replace:
        return records
    empty = {k: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0 for k, c in arrays.items()}
    wanted = F.lit(False)
    for k, c in empty.items():
        wanted = wanted | c if mode in ("missing-either", f"missing-{k}") else wanted
    return records.filter(wanted)


def target_mode(tags: bool = False, categories: bool = False, tools: bool = False) -> str:
    """The mode that flags ask for; several or none of them ask for any."""
    asked_for = [name for name, on in (("tags", tags), ("categories", categories), ("tools", tools)) if on]
    return f"missing-{asked_for[0]}" if len(asked_for) == 1 else "missing-either"


def without_cached(records: DataFrame, cache: DataFrame, key: str, arrays: Mapping[str, Column]) -> DataFrame:
    """Records less those that the cache lists and whose arrays all hold something."""
    complete = F.lit(True)
    for c in arrays.values():
        complete = complete & (F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0)
    known = cache.select(F.col(key).alias("_key")).distinct().withColumn("_cached", F.lit(True))
    return records.join(known, F.col(key) == F.col("_key"), "left").filter(F.col("_cached").isNull() | ~complete).drop("_key", "_cached")


def counters(records: DataFrame, found: DataFrame, changed: DataFrame, key: str = "slug") -> DataFrame:
    """The counts of a run in one row: records asked about, answered in batches, alone and by split questions, without an entry, entries
    of unknown records, changed and unchanged ones, and values added (``changed``: slug, column, n)."""
    told = records.select(F.col(key).alias("slug"), F.lit(1).alias("a")).distinct().join(found.select("slug", "rung"), "slug", "full_outer")
    told = told.join(changed.groupBy("slug").pivot("column", ["categories", "tags", "tools"]).agg(F.sum("n")), "slug", "left").fillna(0, ["categories", "tags", "tools"])
    known, answered_ = F.col("a").isNotNull(), F.col("rung").isNotNull()
    moved = F.col("categories") + F.col("tags") + F.col("tools") > 0
    return told.agg(
        F.count_if(known).alias("recipes"), *(F.count_if(known & (F.col("rung") == r)).alias(f"by_{r}") for r in ("batch", "single", "split")),
        F.count_if(known & ~answered_).alias("no_classification"), F.count_if(~known).alias("unknown_slugs"),
        F.count_if(known & answered_ & moved).alias("updated"), F.count_if(known & answered_ & ~moved).alias("no_change"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_added") for c in ("categories", "tags", "tools")),
    )


# --- lists that people pick from ----------------------------------------------------

def searched(rows: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows in which the text stands in any of the columns, whatever the case."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))), F.lit(text.strip().lower())))


def recommended(available: DataFrame, name: str, order: Sequence[str], extras: bool = True) -> DataFrame:
    """Available names, the recommended ones first and in their order, others after them by name (or left out): name, rank."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    rows = available.select(F.col(name).alias("name"), F.when(rank > 0, rank).alias("rank")).distinct()
    return (rows if extras else rows.filter("rank IS NOT NULL")).orderBy(F.asc_nulls_last("rank"), "name")


def displayed(values: DataFrame, value: str, names: DataFrame, key: str, name: str) -> DataFrame:
    """``values`` with shown: the name of an id, or the value itself where there is none."""
    known = names.groupBy(F.col(key).cast("string").alias("_k")).agg(F.min(name).alias("_n"))
    return values.join(known, F.col(value).cast("string") == F.col("_k"), "left").withColumn("shown", F.coalesce("_n", F.col(value).cast("string"))).drop("_k", "_n")
