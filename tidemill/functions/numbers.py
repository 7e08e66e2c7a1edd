"""Numbers, yields, dates, durations and JSON as Columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import given, once

# Characters that are fractions, as text after a space.
VULGAR_FRACTIONS = {
    "¼": " 1/4", "½": " 1/2", "¾": " 3/4", "⅐": " 1/7", "⅑": " 1/9", "⅒": " 1/10", "⅓": " 1/3", "⅔": " 2/3", "⅕": " 1/5",
    "⅖": " 2/5", "⅗": " 3/5", "⅘": " 4/5", "⅙": " 1/6", "⅚": " 5/6", "⅛": " 1/8", "⅜": " 3/8", "⅝": " 5/8", "⅞": " 7/8",
}
# What a yield is counted in.
YIELD_NOUNS = (
    "serving|portion|piece|cookie|muffin|cup|loaf|slice|biscuit|pancake|waffle|roll|bar|tart|scone|brownie|cake|cupcake|bun|"
    "burger|pita|tortilla|wrap|taco|crepe|donut|doughnut|fritter|dumpling|person|people|ball|patty|skewer|kabob"
)
_NUMBER = r"(\d+(?:\.\d+)?)"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match as a number; null without one."""
    return F.regexp_extract(c, pattern, group).try_cast("double")


def plain_fractions(c: Column) -> Column:
    """Fraction characters as text; one pass over the few texts that have any."""
    known = F.create_map(*(F.lit(x) for pair in VULGAR_FRACTIONS.items() for x in pair))
    written_out = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(known, x), x)), "")
    return F.when(c.rlike(f"[{''.join(VULGAR_FRACTIONS)}]"), written_out).otherwise(c)


def quantity(c: Column) -> Column:
    """The first quantity in a text: a mixed number, a fraction or a decimal; 0 without any, null over zero."""
    return once(plain_fractions(F.coalesce(c, F.lit(""))), lambda text: quantity_in(text))


def quantity_in(text: Column) -> Column:
    """The same of a text without fraction characters."""
    over = lambda a, b: F.try_divide(a, b)
    mixed, plain = r"(\d+)\s+(\d+)/(\d+)", r"(\d+)/(\d+)"
    return (
        F.when(text.rlike(mixed), _found(text, mixed) + over(_found(text, mixed, 2), _found(text, mixed, 3)))
        .when(text.rlike(plain), over(_found(text, plain), _found(text, plain, 2)))
        .otherwise(F.coalesce(_found(text, r"(\d+(?:\.\d+)?)"), F.lit(0.0)))
    )


def yield_number(c: Column) -> Column:
    """How many a yield text tells: dozens, "serves 4", "6 servings", a bare number or range's start, else the
    first quantity; null if it tells none."""
    return once(plain_fractions(F.trim(F.coalesce(c, F.lit("")))), lambda text: yield_number_in(text))


def yield_number_in(text: Column, first: Column | None = None) -> Column:
    """The same of a trimmed text without fraction characters; ``first`` is its first quantity, where that is a column already."""
    to = rf"(?:\s*[-\u2013]\s*\d+(?:\.\d+)?)?"
    dozen, verb = r"(?i)(\d+)\s+dozen", rf"(?i)(?:makes?|serves?|yields?|about)\s+{_NUMBER}"
    noun, bare = rf"(?i)^{_NUMBER}{to}\s+(?:{YIELD_NOUNS})", rf"^{_NUMBER}{to}\z"
    first = quantity_in(text) if first is None else first
    return F.when(text != "", F.coalesce(
        _found(text, dozen) * 12, F.when(text.rlike(r"(?i)\bdozen\b"), F.lit(12.0)),
        _found(text, verb), _found(text, noun), _found(text, bare), F.when(first > 0, first),
    ))


def yield_text(n: Column) -> Column:
    whole = F.floor(n).cast("long")
    return F.concat(whole.cast("string"), F.when(whole == 1, F.lit(" serving")).otherwise(F.lit(" servings")))


def yield_action(text: Column, amount: Column, servings: Column, told: Column | None = None) -> Column:
    """What would make a record's yield fields agree: struct(action, new_text, new_number), null if nothing.

    set_text writes a text for a number, set_servings a number for a text, sync_qty copies the servings.  ``told``: the number
    that the text tells, where it is a column already."""
    amount, servings = F.coalesce(amount, F.lit(0.0)), F.coalesce(servings, F.lit(0.0))
    number = F.when(amount != 0, amount).otherwise(servings)
    told = yield_number(text) if told is None else told
    act = lambda name, new_text, n: F.struct(F.lit(name).alias("action"), new_text.alias("new_text"), n.cast("double").alias("new_number"))
    return (
        F.when(~given(text) & (number > 0), act("set_text", yield_text(number), number))
        .when(given(text) & (number == 0) & (told > 0), act("set_servings", F.trim(text), told))
        .when(given(text) & (servings > 0) & (amount == 0), act("sync_qty", F.trim(text), servings))
    )


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, half to even; 0 of nothing."""
    return F.bround(part * F.lit(100.0) / F.greatest(whole, F.lit(1)), digits)


def truth(c: Column, default: bool | None = None) -> Column:
    """A boolean said in words; ``default`` for anything else."""
    said = F.lower(F.trim(c.cast("string")))
    return F.when(said.isin("1", "true", "yes", "on"), F.lit(True)).when(said.isin("0", "false", "no", "off"), F.lit(False)).otherwise(F.lit(default).cast("boolean"))


def clamped(c: Column, default: int, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(c.try_cast("int"), F.lit(default))))


def moment(c: Column) -> Column:
    """A point in time from ISO text with Z, an offset, neither (UTC) or no seconds; null from anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"^(\d{4}-\d\d-\d\dT\d\d:\d\d)$", "$1:00"))


def elapsed(seconds: Column) -> Column:
    """``12.3s`` below a minute, ``1m 5s`` from there on; what rounds to a minute is one."""
    tenths, whole = F.bround(seconds, 1), F.bround(seconds, 0).cast("long")
    return F.when(tenths < 60, F.format_string("%.1fs", tenths.cast("double"))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))


def clock(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def interval_parts(seconds: Column) -> Column:
    """The largest unit that divides an interval: struct(n, unit)."""
    s = seconds.cast("long")
    unit = F.when(s % 86400 == 0, F.lit("days")).when(s % 3600 == 0, F.lit("hours")).when(s % 60 == 0, F.lit("minutes")).otherwise(F.lit("seconds"))
    size = F.when(s % 86400 == 0, F.lit(86400)).when(s % 3600 == 0, F.lit(3600)).when(s % 60 == 0, F.lit(60)).otherwise(F.lit(1))
    return F.struct(F.floor(s / size).cast("long").alias("n"), unit.alias("unit"))


# --- JSON -------------------------------------------------------------------------

def value_list(c: Column) -> Column:
    """The strings between a filter's brackets: JSON if they parse, else what stands between commas, without quotes."""
    text = F.trim(F.coalesce(c, F.lit("")))
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    loose = F.transform(F.split(text, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))
    return F.filter(F.transform(F.coalesce(parsed, loose), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def version(c: Column) -> Column:
    """A short name for a document's very content."""
    return F.left(F.sha2(F.coalesce(c, F.lit("")), 256), F.lit(16))


@F.pandas_udf(StringType())
def repaired_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text from a model's loose reply: without fences and talk around it, with straight quotes, quoted keys
    and no trailing commas, a cut list closed after its last whole object, and a lone list unwrapped from an
    object; null if that is not JSON either."""
    import json
    import re

    quotes = str.maketrans({"\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'"})

    def parsed(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return None

    def closed(text: str) -> str:
        """The text up to the last object that ends at the list's level, and the list's end."""
        depth, last, inside, escaped = 0, -1, False, False
        for i, c in enumerate(text):
            if inside:
                inside, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                inside = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                last = i if c == "}" and depth == 1 else last
        return text[: last + 1] + "]" if last > 0 else text

    def without_commas(text: str) -> str:
        return re.sub(r",\s*([\]}])", r"\1", text.translate(quotes))

    def loosened(text: str) -> str:
        text = without_commas(text)
        text = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', text)
        return re.sub(r"(?<=[\[{,:])(\s*)'([^']*)'(?=\s*[,:\]}])", r'\1"\2"', text)

    def repaired(text: str | None) -> str | None:
        if not text or not text.strip():
            return None
        text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
        tries = [text]
        start = re.search(r"[\[{]", text)
        if start:
            end = max(text.rfind("]"), text.rfind("}"))
            inner = text[start.start():end + 1] if end > start.start() else text[start.start():]
            tail = text[start.start():]
            tries += [inner, inner.translate(quotes), without_commas(inner), loosened(inner), closed(tail), loosened(closed(tail))]
        for t in tries:
            value = parsed(t)
            if value is not None:
                if isinstance(value, dict) and len(value) == 1 and isinstance(next(iter(value.values())), list):
                    value = next(iter(value.values()))
                return json.dumps(value, ensure_ascii=False, sort_keys=True)
        return None

    for s in texts:
        yield s.map(repaired, na_action="ignore").astype(object)
