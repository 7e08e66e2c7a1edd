"""Personal data by regular expressions, checksums and context, in DataFrame functions alone.

Expressions propose spans, checksum validators (Luhn, mod 97) confirm them, and words near a span
adjust its score.  The expressions match what the plain ones in their comments match, but take
linear time and constant stack on any text: Java's engine recurses once for each turn of a group
and starts anew at each character of a run, so runs are possessive and entered at their start, and
groups are bounded or replaced by classes with a lookahead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # an expression that every match holds, cheap to look for
    valid: object = None  # of a match, whether it counts
    base: float = 0.5  # score before the context's share
    context: str = ""  # words whose nearness adds to the score
    needs_context: bool = False


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test: from the right, each second digit counts
    twice, less 9 if that is over 9, and the sum is a multiple of 10."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    turned = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(turned, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes ISO 7064: the first four characters go to the end,
    letters count 10 to 35, and the number's remainder by 97 is 1."""
    turned = F.concat(F.substring(iban, 5, 34), F.substring(iban, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1


def _small_parts(ip: Column) -> Column:
    """All parts at most 255, whatever their leading zeros."""
    return F.forall(F.split(ip, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\\z"))


#: The kinds in the order of their listing; the first four are the base kinds.
KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; \G admits a local part that begins where the last match ended.
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++\.{_DOMAIN}++[A-Za-z0-9.-]*?(?=\.?(?:[^A-Za-z0-9.-]|\z)|\.\.)", "@", base=0.9, context="mail|contact|write"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", valid=_small_parts, base=0.6, context="ip|address|host|server|login"),
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits: a whole run of digits with single separators.
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", "[0-9][ -]?[0-9]", valid=lambda m: luhn(_digits(m)), base=0.7, context="card|visa|credit|payment|karte|carte|tarjeta"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", valid=lambda m: F.length(_digits(m)).between(8, 15), base=0.7, context="phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", valid=lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), base=0.9, context="iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", base=0.4, context="ssn|social|security|tax"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9a-f]{32}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9_])", "[0-9a-f]{32}|AKIA|gh[pousr]_", base=0.3, context="token|key|secret|password|passwd|auth|bearer", needs_context=True),
]
BASE_KINDS = ["email", "ip", "card", "phone"]
#: Characters before and after a span that count as near, and what a context word near a span adds to its score.
NEAR = 40
CONTEXT_SHARE = 0.1
#: Matches of a text whose lengths are summed up one by one.
BLOCK = 256


def _let(value: Column, of) -> Column:
    """``of`` a value that is computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _starts(lengths: Column) -> Column:
    """Where pieces of such lengths begin, laid end to end.  Sums run within blocks and over the blocks, so that no array is copied
    for each piece."""
    def within(n: Column, begin: Column) -> Column:
        return F.transform(n, lambda x, i: F.element_at(begin, F.floor(i / BLOCK).cast("int") + 1) + F.aggregate(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, y: a + y))

    def begun(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(n, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, y: a + y))
        return F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    return _let(lengths, lambda n: _let(begun(n), lambda begin: within(n, begin)))


def _spans(text: Column, kind: Kind) -> Column:
    """The kind's matches that count: array<struct<kind, start, end, score>>, in code points.

    Text split at the matches has one piece more than there are matches, so a match starts after
    the pieces and matches before it."""
    near = lambda s: F.concat_ws(" ", F.substr(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)), F.least(s["start"], F.lit(NEAR))), F.substr(text, s["end"] + 1, F.lit(NEAR)))
    said = lambda s: near(s).rlike(rf"(?i)(?<![A-Za-z])(?:{kind.context})") if kind.context else F.lit(False)

    def scored(matches: Column) -> Column:
        pieces = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
        paired = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), m.alias("m")))
        walked = _let(paired, lambda z: F.zip_with(z, _starts(F.transform(z, lambda x: x["gap"] + x["n"])), lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["m"].alias("m"),
        )))
        counted = F.filter(walked, lambda s: kind.valid(s["m"])) if kind.valid else walked
        if kind.needs_context:
            counted = F.filter(counted, said)
        return F.transform(counted, lambda s: F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.when(said(s), F.lit(kind.base + CONTEXT_SHARE)).otherwise(F.lit(kind.base)).alias("score"),
        ))

    matches = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1))
    return F.when(text.rlike(kind.gate), _let(matches, lambda m: F.when(F.size(m) > 0, scored(m))))


def pii_spans(docs: DataFrame, kinds: list[Kind] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and an array of spans for each kind
    (kind, start, end, score; code points, end exclusive).

    A null text counts as empty; an empty text has no spans.  Repeated rows are judged each for
    itself; further columns are ignored."""
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    filled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return filled.select("doc_id", *(F.coalesce(_spans(text, k), none).alias(k.name) for k in (KINDS if kinds is None else kinds)))


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`pii_spans`: counts and hash of the base kinds, all spans as text, and
    the highest score (0 without spans)."""
    told = lambda c: F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    together = lambda names: F.array_join(F.concat(*(told(F.col(n)) for n in names)), ",")
    return pii_spans(docs).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(together(BASE_KINDS), 256).alias("base_sha256"), together([k.name for k in KINDS]).alias("spans"),
        F.coalesce(F.array_max(F.transform(F.concat(*(F.col(k.name) for k in KINDS)), lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
