"""Text functions as Columns: name keys, slugs, titles, URLs, lines.

All are built-in expressions but the Unicode ones at the end, for which Spark has none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Query parameters that only track where a visitor came from.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid",
    "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "s", "spm",
]
# Words that a title keeps in lower case unless they come first or last.
SMALL_WORDS = [
    "a", "an", "the", "and", "but", "or", "nor", "for", "yet", "so", "at", "by", "in", "of", "on", "to", "up", "as",
    "from", "into", "with", "over", "via", "per", "vs",
]
# Abbreviations that a title keeps in upper case.
ACRONYMS = ["bbq", "blt", "gf", "diy", "pb", "pbj", "xo", "hk", "thc", "vgf", "ac"]
# Phrases dropped from the beginning of a title, in this order.
TITLE_PREFIXES = [r"recipe\s+for\s+", r"how\s+to\s+(?:make|cook)\s+", r"how\s+to\s+", r"(?:make|cook)\s+"]


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a column that many expressions look at, computed once."""
    return F.element_at(F.transform(F.array(c), of), 1)


def given(c: Column) -> Column:
    """Whether a text holds more than white space; null doesn't."""
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def first_given(*cs: Column) -> Column:
    """The first of the texts that holds more than white space, trimmed; else an empty text."""
    return F.coalesce(*(F.when(given(c), F.trim(c)) for c in cs), F.lit(""))


def collapsed(c: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def name_key(c: Column) -> Column:
    """The key under which names are equal, for texts in which lower case is case folding."""
    return F.lower(collapsed(c))


def similarity_key(c: Column) -> Column:
    """Lower case with every run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def plain_slug(c: Column, longest: int = 250) -> Column:
    """Lower-case letters and digits with hyphens between, cut at ``longest`` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(longest))


def numeric_suffix(c: Column) -> Column:
    """Whether a name ends in a number in parentheses, as copies of a record do."""
    return F.coalesce(c, F.lit("")).rlike(r"\(\d+\)$")


def short(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of them dots if more were there."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def split_names(c: Column) -> Column:
    """The names between commas and semicolons, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def _any(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands in the text, inside longer words too."""
    return F.exists(_any(words), lambda w: F.contains(c, w))


# --- titles -------------------------------------------------------------------

_EDGE = r"""[,:;!?"'()\-]"""


def stripped_title(c: Column) -> Column:
    """Separators as spaces, and without the phrases that begin or end scraped titles."""
    out = collapsed(F.translate(c, "-_", "  "))
    for prefix in TITLE_PREFIXES:
        out = F.trim(F.regexp_replace(out, f"(?i)^{prefix}", ""))
    return F.trim(F.regexp_replace(out, r"(?i)\s+recipe$", ""))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def title_case(c: Column) -> Column:
    """English title case: small words stay small inside, abbreviations are all capitals, one letter before
    an apostrophe makes the next a capital (O'Brien), and punctuation around a word is left alone."""
    words = F.split(collapsed(F.lower(c)), " ")
    last = F.size(words) - 1

    def cased(word: Column, i: Column) -> Column:
        lead = F.regexp_extract(word, f"^({_EDGE}*)", 1)
        rest = F.substr(word, F.length(lead) + 1)
        trail = F.regexp_extract(rest, f"({_EDGE}*)$", 1)
        core = F.left(rest, F.length(rest) - F.length(trail))
        head = F.substring_index(core, "'", 1)
        tail = F.substr(core, F.length(head) + 2)
        quoted = F.concat(_capital(head), F.lit("'"), F.when((F.length(head) == 1) & tail.rlike("^[a-zà-öø-ÿ]"), F.concat(F.upper(F.left(tail, F.lit(1))), F.substr(tail, F.lit(2)))).otherwise(tail))
        named = (
            F.when(head.isin(ACRONYMS), F.concat(F.upper(head), F.substr(core, F.length(head) + 1)))
            .when((i > 0) & (i < last) & core.isin(SMALL_WORDS), core)
            .when(F.contains(core, F.lit("'")), quoted)
            .otherwise(_capital(core))
        )
        return F.when(core == "", word).otherwise(F.concat(lead, named, trail))

    return F.array_join(F.transform(words, cased), " ")


def clean_title(c: Column) -> Column:
    return title_case(stripped_title(c))


def needs_title(name: Column, slug: Column, every: bool = False) -> Column:
    """Whether a name should be replaced by its clean title: it differs, and has no capital unless ``every`` name counts."""
    differs = given(name) & given(slug) & (clean_title(name) != F.trim(name))
    return differs if every else differs & ~name.rlike("[A-Z]")


# --- URLs -----------------------------------------------------------------------

def _encoded(c: Column) -> Column:
    """Percent encoding of form data as browsers and most libraries write it."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def canonical_url(c: Column) -> Column:
    """An address under which copies of a page meet: scheme (https if none) and host in lower case, leading
    ``w`` and ``.`` characters of the host dropped, single slashes without one at the end, no fragment, and the
    query's parameters sorted, the last of a name kept, blank and tracking ones dropped."""
    url = F.trim(F.coalesce(c, F.lit("")))
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    scheme = F.lower(F.coalesce(F.nullif(part("^([A-Za-z][A-Za-z0-9+.-]*):"), F.lit("")), F.lit("https")))
    host = F.ltrim(F.lower(part("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)")), F.lit("w."))
    path = F.regexp_replace(part("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)"), "/+", "/")
    path = F.coalesce(F.nullif(F.regexp_replace(path, "(?<=.)/$", ""), F.lit("")), F.lit("/"))
    pairs = F.filter(F.split(part(r"^[^?#]*\?([^#]*)"), "&"), lambda p: p.rlike("^[^=]*=."))
    entries = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    entries = F.filter(entries, lambda e: ~F.lower(e["k"]).isin(TRACKING_PARAMS))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["k"] == e["k"]))
    query = F.array_join(F.transform(F.array_sort(last), lambda e: F.concat(_encoded(e["k"]), F.lit("="), _encoded(e["v"]))), "&")
    return F.when(url == "", F.lit("")).otherwise(F.concat(scheme, F.lit("://"), host, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


# --- where Spark has no function --------------------------------------------------

@F.pandas_udf(StringType())
def folded_key(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The key under which names are equal in any script: compatibility forms composed, case folded, spaces collapsed."""
    for s in names:
        yield s.fillna("").map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@F.pandas_udf(StringType())
def latin_slug(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A slug in which accented Latin letters lose their accents; other scripts are dropped."""
    for s in names:
        plain = s.fillna("").str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii").str.lower()
        yield plain.str.replace("'", "", regex=False).str.replace("[^a-z0-9]+", "-", regex=True).str.strip("-").str.slice(0, 250)


@F.pandas_udf(DoubleType())
def matching_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the characters in matching blocks over the characters of both texts (Ratcliff and Obershelp)."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([SequenceMatcher(a=x or "", b=y or "").ratio() for x, y in zip(a, b)], dtype="float64")
