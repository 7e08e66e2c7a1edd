"""Regex rules over records: generation from names, matching in one pass, what to do with targets."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapsed
from .gates import finds_each, gated, one_word

#: Rules up to which each is a column of its own.
GATED = 32


@dataclass(frozen=True)
class Rule:
    """``section`` names what the rule adds (and from what), ``match_on`` is name, description or both.  With ``ascii`` the bounds
    of words are those of A-Z, a-z, 0-9 and _, as in SQL engines that match bytes; else all letters and digits make up words."""

    section: str
    target: str
    pattern: str
    match_on: str = "both"
    enabled: bool = True
    exclude: str = ""
    min_matches: int = 1
    ascii: bool = False


#: A character of an ASCII word; it has its own flag, as k would be the Kelvin sign too if case did not matter.
_WORD = "(?-i:[0-9A-Za-z_])"
_BOUNDS = {r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", r"\B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"}


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with ``\b`` and ``\B`` between ASCII words; what is quoted or in a class stays."""
    depth = 0

    def each(m: re.Match[str]) -> str:
        nonlocal depth
        depth = max(depth + {"[": 1, "]": -1}.get(m[0], 0), 0)
        return m[0] if depth else _BOUNDS.get(m[0], m[0])

    return re.sub(r"(?s)\\Q.*?(?:\\E|\Z)|\\b\{|\\.|[\[\]]", each, pattern)


def pattern_for(name: Column) -> Column:
    r"""A pattern that finds a name: its letters and digits, with white space, hyphens or underscores between, as whole
    words; a name without any is looked for as it is."""
    tokens = F.regexp_extract_all(collapsed(name), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    core = F.array_join(tokens, r"[\s_-]+")
    plain = F.regexp_replace(collapsed(name), r"([^A-Za-z0-9_\s])", r"\\$1")
    return F.when(F.size(tokens) > 0, F.concat(F.lit(r"\b"), core, F.lit(r"\b"))).when(collapsed(name) != "", F.concat(F.lit(r"\b"), plain, F.lit(r"\b"))).otherwise(F.lit(""))


def rules_from(names: DataFrame, column: str, section: str, match_on: str = "both") -> DataFrame:
    """One rule for each name, of those with one key the first by name: section, target, pattern, match_on."""
    kept = names.select(collapsed(F.col(column)).alias("name")).filter("name <> ''").groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("target"))
    return kept.select(F.lit(section).alias("section"), "target", pattern_for(F.col("target")).alias("pattern"), F.lit(match_on).alias("match_on")).orderBy(F.lower("target"))


def usable(rules: Sequence[Rule], spark: SparkSession) -> list[Rule]:
    """Enabled rules with a target and patterns that compile where they will run, which read as they are run; the driver checks, so that
    no task fails on one."""
    compiled: dict[str, bool] = {}
    rules = [replace(r, pattern=ascii_bounds(r.pattern), exclude=ascii_bounds(r.exclude), ascii=False) if r.ascii else r for r in rules]

    def compiles(pattern: str) -> bool:
        if pattern not in compiled:
            try:
                spark._jvm.java.util.regex.Pattern.compile(f"(?iu){pattern}")
                compiled[pattern] = True
            except (IllegalArgumentException, Py4JJavaError):
                compiled[pattern] = False
        return compiled[pattern]

    return [r for r in rules if r.enabled and r.target.strip() and r.pattern.strip() and compiles(r.pattern) and compiles(r.exclude)]


def finds(text: Column, pattern: str) -> Column:
    """Whether a text matches, whatever its case; a null one doesn't."""
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def text_matches(records: DataFrame, rules: Sequence[Rule], key: str, name: str, description: str) -> DataFrame:
    """key, section, target of every rule that a record's name or description matches.

    All rules are columns of one scan; rows only appear for matches.  More than ``GATED`` rules go through :mod:`gates`."""
    fields = {"name": [name], "description": [description]}
    kept = usable(rules, records.sparkSession)
    if len(kept) > GATED:
        return gated_matches(records, kept, key, name, description)
    hits = []
    for r in kept:
        said = [finds(F.col(c), r.pattern) for c in fields.get(r.match_on, [name, description])]
        hit = said[0] if len(said) == 1 else said[0] | said[1]
        if r.exclude:
            barred = [finds(F.col(c), r.exclude) for c in fields.get(r.match_on, [name, description])]
            hit = hit & ~(barred[0] if len(barred) == 1 else barred[0] | barred[1])
        hits.append(F.when(hit, F.struct(F.lit(r.section).alias("section"), F.lit(r.target).alias("target"))))
    if not hits:
        return records.select(key, F.lit("").alias("section"), F.lit("").alias("target")).limit(0)
    return records.select(key, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(key, "hit.section", "hit.target").distinct()


def gated_matches(records: DataFrame, rules: Sequence[Rule], key: str, name: str, description: str) -> DataFrame:
    """The same for any number of rules that are usable: a rule of one word is looked up among a record's words, and of the others only those run
    on a record that an automaton leaves open for it; neither the plan nor, but for the matches themselves, the time grows with the rules."""
    names = ("section", "target", "pattern", "exclude", "name", "description")
    known = [(r.section, r.target, r.pattern, r.exclude, r.match_on != "description", r.match_on != "name") for r in rules]
    values = pa.StructArray.from_arrays([pa.array(c, pa.string() if k < 4 else pa.bool_()) for k, c in enumerate(zip(*known, strict=True))], names)
    texts = {c: [i for i, k in enumerate(known) if k[at]] for at, c in ((4, "name"), (5, "description"))}
    plain = [one_word(r.pattern) is not None and not r.exclude for r in rules]
    wide = not records.sparkSession._jvm.java.util.regex.Pattern.compile(r"(?iu)a\b").matcher("a\u00e9").find()
    rows = records.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(description).alias("description"))
    told = gated(rows, [r.pattern for r in rules], texts, plain, values, wide)

    def hit(r: Column) -> Column:
        said = lambda p: (r["name"] & finds_each(F.col("name"), p)) | (r["description"] & finds_each(F.col("description"), p))
        return said(r["pattern"]) & ~said(r["exclude"])

    found = told.select("key", F.explode(F.transform(F.concat("sure", F.filter("open", hit)), lambda r: F.struct(r["section"].alias("section"), r["target"].alias("target")))).alias("hit"))
    return found.select(F.col("key").alias(key), "hit.section", "hit.target").distinct()


def step_matches(steps: DataFrame, rules: Sequence[Rule], key: str, text: str) -> DataFrame:
    """key, section, target of the rules that any of a record's steps matches (one row a step)."""
    return text_matches(steps, rules, key, text, text)


def part_matches(parts: DataFrame, names: DataFrame, rules: Sequence[Rule], key: str, part: str, name: str) -> DataFrame:
    """key, section, target of the rules that match ``min_matches`` distinct parts of a record (links: key, part; names: part, name).

    The rules run once on each name, not on each link."""
    hits = [
        F.when(finds(F.col(name), r.pattern) & (~finds(F.col(name), r.exclude) if r.exclude else F.lit(True)), F.struct(F.lit(r.section).alias("section"), F.lit(r.target).alias("target"), F.lit(r.min_matches).alias("needed")))
        for r in usable(rules, names.sparkSession)
    ]
    named = names.select(part, F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    counted = parts.select(key, part).join(named, part).groupBy(key, "hit").agg(F.count_distinct(part).alias("n"))
    return counted.filter(F.col("n") >= F.col("hit.needed")).select(key, "hit.section", "hit.target").distinct()


def matched_counts(matches: DataFrame, key: str) -> DataFrame:
    """section, target and the number of records matched, already linked ones too."""
    return matches.groupBy("section", "target").agg(F.count_distinct(key).alias("matched"))


def new_links(matches: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Matches that are no links (key, target) yet."""
    return matches.select(key, "target").distinct().join(linked, [key, "target"], "left_anti")


def resolved(rules: DataFrame, targets: DataFrame, create: bool = False) -> DataFrame:
    """Rules with what becomes of their targets: action is keep, rename (the target's own spelling differs), create or drop."""
    known = targets.select(F.lower(collapsed(F.col("name"))).alias("key"), collapsed(F.col("name")).alias("known")).groupBy("key").agg(F.min("known").alias("known"))
    action = F.when(F.col("known").isNull(), F.lit("create" if create else "drop")).when(F.col("known") != F.col("target"), "rename").otherwise("keep")
    return rules.withColumn("key", F.lower(collapsed(F.col("target")))).join(known, "key", "left").withColumn("action", action).drop("key")
