"""Which records to take up, their lines, and what isn't a record at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, contains_any, first_given, once

# Words and addresses that mark pages which are no records.
JUNK_KEYWORDS = [
    "cleaning", "storing", "freezing", "pantry", "kitchen tools", "review", "giveaway", "shop", "store", "product", "gift", "unboxing",
    "news", "travel", "podcast", "interview", "night cream", "face mask", "skin care", "beauty", "diy", "detox water", "lose weight",
    "taste test", "clear winner", "foods to try", "things to eat", "we tried", "we tasted", "we tested", "we ranked", "we compared",
    "just launched", "just released", "is sabotaging", "start with these",
]
UTILITY_SLUGS = ["privacy-policy", "contact", "about-us", "about", "login", "cart", "checkout", "terms", "terms-of-service", "disclaimer", "sitemap", "404", "page-not-found"]
BAD_INSTRUCTIONS = ["could not detect instructions", "instruction unavailable", "no instructions found", "instructions not available", "unable to extract instructions"]
HOW_TO = r"^how\s+to\s+(?:make|cook)\b"
LISTICLE = (
    r"\b(top|best)\b.*\b(recipes?|meals?|dishes?|desserts?|breakfasts?|lunches?|dinners?|snacks?|drinks?)\b"
    r"|^\s*\d{1,3}\b.*\b(recipes?|meals?|dishes?)\b"
)
DIGEST = (
    r"\b(friday\s*finds?|sunday\s*stuff|weekly\s*round\s*up|monthly\s*report|weekend\s*reads?|favorites?\s*of\s*the\s*week"
    r"|what\s*i\s*ate|meal\s*plan|menu\s*plan|weekly\s*menu|holiday\s*guide)\b"
)
# How headings among ingredient lines begin, notes that need no quantity, and units that need none.
HEADER_WORDS = r"^(?:for|to)\s"
SERVING_PHRASES = ["for serving", "for garnish", "for dipping"]
UNITS_WITHOUT_QUANTITY = ["pinch", "dash"]


def junk_class(name: Column, slug: Column, instructions: Column, keywords: Sequence[str] = JUNK_KEYWORDS) -> Column:
    """Why a page is no record: the first of how_to, listicle, digest, keyword, utility and bad_instructions that holds; null if none does."""
    def cascade(x: Column) -> Column:
        n, s, i = x["n"], x["s"], x["i"]
        return (
            F.when(n.rlike(HOW_TO), "how_to").when(n.rlike(LISTICLE), "listicle")
            .when(n.rlike(DIGEST) | F.replace(s, F.lit("-"), F.lit(" ")).rlike(DIGEST), "digest")
            .when(contains_any(n, keywords), "keyword").when(contains_any(s, UTILITY_SLUGS), "utility").when(contains_any(i, BAD_INSTRUCTIONS), "bad_instructions")
        )
    return once(F.struct(*(F.lower(F.coalesce(c, F.lit(""))).alias(k) for k, c in (("n", name), ("s", slug), ("i", instructions)))), cascade)


def candidates(records: DataFrame, cache: DataFrame, key: str, flag: Column, updated: Column, recheck: bool = False) -> DataFrame:
    """Records with their decision: done (flag true), take (flag false, or not cached as they are now), cached.

    ``cache`` (key, updated_at, status) tells what was seen at which state; needs_review is taken again if ``recheck``."""
    settled = ["already_parsed", "empty", "parsed"] + ([] if recheck else ["needs_review"])
    seen = cache.filter("updated_at <> '' AND status <> ''").groupBy(key).agg(F.max_by(F.struct("updated_at", "status"), F.col("updated_at")).alias("seen"))
    fresh = F.coalesce((F.col("seen.updated_at") == updated) & F.col("seen.status").isin(settled), F.lit(False))
    decision = F.when(flag, "done").when(~flag, "take").when(fresh, "cached").otherwise("take")
    return records.join(seen, key, "left").withColumn("decision", decision).drop("seen")


def after_cursor(records: DataFrame, order: str, cursor: str | None) -> DataFrame:
    """Records after the cursor in ``order``; all of them if no record is at the cursor."""
    if cursor is None:
        return records
    known = records.filter(F.col(order) == cursor).limit(1).select(F.lit(True)).scalar()
    return records.filter(known.isNull() | (F.col(order) > cursor))


def header_line(line: Column) -> Column:
    """Whether a line heads others: short, without digits, and ending in a colon or beginning like a heading; or blank."""
    text = F.trim(line)
    brief = (F.size(F.split(text, r"\s+")) <= 8) & ~text.rlike(r"\d")
    return (text == "") | (brief & (text.endswith(":") | F.lower(text).rlike(HEADER_WORDS)))


def clean_lines(lines: Column) -> Column:
    """Lines of an array with single spaces, without blank ones and headers."""
    return F.filter(F.transform(lines, collapsed), lambda x: ~header_line(x))


def raw_lines(items: Column) -> Column:
    """The text of each ingredient (struct of food, original_text, raw_text, note, display), blank ones left out; null
    if any of them has a food, as those are parsed already."""
    texts = F.filter(F.transform(items, lambda x: first_given(x["original_text"], x["raw_text"], x["note"], x["display"])), lambda x: x != "")
    return F.when(~F.exists(items, lambda x: x["food"].isNotNull()), texts)


def suspicion(note: Column, quantity: Column, food: Column, unit: Column) -> Column:
    """What is odd about a parsed ingredient (food and unit by name): zero_qty_with_unit or missing_food_no_note; null if nothing."""
    said, n = F.lower(F.trim(F.coalesce(note, F.lit("")))), F.coalesce(quantity, F.lit(0.0))
    blank = (said == "") & (n == 0) & food.isNull() & unit.isNull()
    return (
        F.when(blank | contains_any(said, SERVING_PHRASES), F.lit(None).cast("string"))
        .when((n == 0) & unit.isNotNull(), F.when(~F.contains(said, F.lit("to taste")) & ~F.lower(F.trim(unit)).isin(UNITS_WITHOUT_QUANTITY), "zero_qty_with_unit"))
        .when(food.isNull() & (said == ""), "missing_food_no_note")
    )


def accepted(confidences: Column, least: float = 0.8) -> Column:
    """Whether all lines of a record were parsed with enough confidence; none were if there are no lines."""
    return (F.size(confidences) > 0) & F.forall(confidences, lambda c: F.coalesce(c, F.lit(0.0)) >= least)


def first_accepted(attempts: DataFrame, key: str, order: Sequence[str], least: float = 0.8) -> DataFrame:
    """Of several strategies' parses (key, strategy, confidences) the first in ``order`` that is accepted: key, strategy."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    good = attempts.filter(accepted(F.col("confidences"), least) & (rank > 0))
    return good.groupBy(key).agg(F.min_by("strategy", rank).alias("strategy"))


def attempts_log(attempts: DataFrame, key: str, order: Sequence[str], least: float = 0.8) -> DataFrame:
    """key, strategy and outcome of the strategies that are tried until one is accepted: those in ``order`` up to it, or all of them."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    good = accepted(F.col("confidences"), least)
    outcome = F.when(F.size(F.coalesce("confidences", F.array().cast("array<double>"))) == 0, "empty parser response").when(good, "accepted").otherwise("below confidence threshold")
    rows = attempts.filter(rank > 0).select(key, "strategy", rank.alias("_rank"), outcome.alias("outcome"))
    first = rows.groupBy(key).agg(F.min(F.when(F.col("outcome") == "accepted", F.col("_rank"))).alias("_first"))
    return rows.join(first, key).filter("_first IS NULL OR _rank <= _first").select(key, "strategy", "outcome")


def unprocessed(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records that a checkpoint doesn't list."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def appended(have: Column, new: Column) -> Column:
    """An array with the new values that it lacks at its end."""
    none = F.array().cast("array<string>")
    have, new = F.coalesce(have, none), F.coalesce(new, none)
    return F.concat(have, F.filter(F.array_distinct(new), lambda x: ~F.array_contains(have, x)))
