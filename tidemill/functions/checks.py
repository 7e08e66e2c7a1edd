"""Whether texts have the form that a field asks for, and entries of loose JSON as typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import truth
from .text import collapsed, name_key, split_names

#: The colour of a label that names none, and hosts that no service address may have.
LABEL_COLOR = "#959595"
BLOCKED_HOSTS = ["169.254.169.254", "metadata.google.internal"]


def username(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^[a-zA-Z0-9_.-]{3,64}\z"), F.lit(False))


def password(c: Column) -> Column:
    """At least eight characters with a capital, a small letter and a digit."""
    return F.coalesce(c.rlike(r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{8,}\z"), F.lit(False))


def env_key(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Z0-9_]+\z"), F.lit(False))


def host(c: Column) -> Column:
    """A host name or address: parts of letters, digits and hyphens between dots, no part beginning or ending in a hyphen."""
    part = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    return F.coalesce((F.length(c) <= 253) & c.rlike(rf"^{part}(?:\.{part})*\z"), F.lit(False))


def account(c: Column) -> Column:
    """A user of a remote machine."""
    return F.coalesce(c.rlike(r"^[a-z_][a-z0-9_.-]{0,31}\z"), F.lit(False))


def container(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9_.-]*\z"), F.lit(False))


def service_url(c: Column) -> Column:
    """An http or https address of a host that isn't blocked."""
    found = F.lower(F.regexp_extract(c, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.lower(F.regexp_extract(c, "^([A-Za-z]+)://", 1)).isin("http", "https") & ~found.isin(BLOCKED_HOSTS), F.lit(False))


# --- loose JSON -----------------------------------------------------------------

def members(c: Column) -> Column:
    """The members of a JSON list as texts: strings as they are, objects as JSON; null if the text is no list."""
    return F.from_json(c, "array<string>")


def is_object(c: Column) -> Column:
    return F.coalesce(F.trim(c).startswith("{"), F.lit(False))


def unique_by_name(entries: Column) -> Column:
    """Entries (structs with name) with a name, the first of each name whatever its case."""
    named = F.filter(entries, lambda e: F.coalesce(e["name"], F.lit("")) != "")
    keys = F.transform(named, lambda e: name_key(e["name"]))
    return F.filter(named, lambda e, i: F.array_position(keys, name_key(e["name"])) == i + 1)


def _field(c: Column, name: str) -> Column:
    return collapsed(F.get_json_object(c, f"$.{name}"))


def named_entries(c: Column) -> Column:
    """Names of a JSON list of strings and objects: array<struct<name>>."""
    each = F.transform(F.coalesce(members(c), F.array().cast("array<string>")), lambda x: F.struct(F.when(is_object(x), _field(x, "name")).otherwise(collapsed(x)).alias("name")))
    return unique_by_name(each)


def label_entries(c: Column) -> Column:
    """Labels: array<struct<name, color>>, with a colour for those that have none."""
    color = lambda x: F.coalesce(F.nullif(F.when(is_object(x), _field(x, "color")), F.lit("")), F.lit(LABEL_COLOR))
    each = F.transform(F.coalesce(members(c), F.array().cast("array<string>")), lambda x: F.struct(F.when(is_object(x), _field(x, "name")).otherwise(collapsed(x)).alias("name"), color(x).alias("color")))
    return unique_by_name(each)


def tool_entries(c: Column) -> Column:
    """Tools: array<struct<name, on_hand>>; strings aren't on hand."""
    held = lambda x: F.coalesce(F.when(is_object(x), truth(F.get_json_object(x, "$.onHand"))), F.lit(False))
    each = F.transform(F.coalesce(members(c), F.array().cast("array<string>")), lambda x: F.struct(F.when(is_object(x), _field(x, "name")).otherwise(collapsed(x)).alias("name"), held(x).alias("on_hand")))
    return unique_by_name(each)


def unit_entries(c: Column) -> Column:
    """Units of objects: array<struct<name, plural, abbreviation, plural_abbreviation, description, fraction, use_abbreviation, aliases>>.
    The name may stand under canonical; abbreviations that differ from it count as aliases too."""
    def one(x: Column) -> Column:
        name = F.coalesce(F.nullif(_field(x, "name"), F.lit("")), _field(x, "canonical"))
        raw = F.get_json_object(x, "$.aliases")
        listed = F.coalesce(F.from_json(raw, "array<string>"), split_names(raw))
        short = [F.nullif(_field(x, n), F.lit("")) for n in ("abbreviation", "pluralAbbreviation")]
        more = F.array_compact(F.array(*(F.when(name_key(s) != name_key(name), s) for s in short)))
        aliases = F.filter(F.transform(F.concat(listed, more), collapsed), lambda a: a != "")
        keys = F.transform(aliases, name_key)
        return F.struct(
            name.alias("name"), F.nullif(_field(x, "pluralName"), F.lit("")).alias("plural"), short[0].alias("abbreviation"), short[1].alias("plural_abbreviation"),
            F.nullif(_field(x, "description"), F.lit("")).alias("description"), F.coalesce(truth(F.get_json_object(x, "$.fraction")), F.lit(True)).alias("fraction"),
            F.coalesce(truth(F.get_json_object(x, "$.useAbbreviation")), F.lit(False)).alias("use_abbreviation"),
            F.filter(aliases, lambda a, i: F.array_position(keys, name_key(a)) == i + 1).alias("aliases"),
        )
    objects = F.filter(F.coalesce(members(c), F.array().cast("array<string>")), is_object)
    return unique_by_name(F.transform(objects, one))


def shape(c: Column) -> Column:
    """What a JSON list holds: units, cookbooks, strings, names (objects of a name alone) or mixed; null for anything else."""
    xs = members(c)
    has = lambda x, *names: F.arrays_overlap(F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    objects = F.forall(xs, lambda x: is_object(x) & F.get_json_object(x, "$.name").isNotNull())
    return (
        F.when(F.exists(xs, lambda x: is_object(x) & has(x, "aliases", "canonical", "abbreviation")), "units")
        .when(objects & F.exists(xs, lambda x: has(x, "queryFilterString", "public", "position")), "cookbooks")
        .when(F.forall(xs, lambda x: ~is_object(x)), "strings")
        .when(objects & F.forall(xs, lambda x: F.size(F.json_object_keys(x)) == 1), "names")
        .when(xs.isNotNull(), "mixed")
    )


def instructions(c: Column) -> Column:
    """The text of instructions that are a string, a list of strings or a list of objects (text, else name), as one line."""
    xs = members(c)
    said = lambda x: F.when(is_object(x), F.coalesce(F.nullif(F.get_json_object(x, "$.text"), F.lit("")), F.get_json_object(x, "$.name"), F.lit(""))).otherwise(x)
    return F.when(xs.isNotNull(), F.array_join(F.transform(xs, said), " ")).otherwise(F.coalesce(c, F.lit("")))


def at_path(c: Column, path: str, default: str | None = None) -> Column:
    """What stands at a dotted path of a JSON text, or the default."""
    steps = "".join(f"['{p}']" for p in path.split("."))
    return F.coalesce(F.get_json_object(c, f"${steps}"), F.lit(default))


def any_truthy(values: Column) -> Column:
    """Whether any value of a map of texts says something: null, empty texts, 0 and false don't."""
    return F.coalesce(F.exists(F.map_values(values), lambda v: F.coalesce((F.trim(v) != "") & ~F.lower(F.trim(v)).isin("0", "0.0", "false", "null"), F.lit(False))), F.lit(False))


def stable_json(c: Column, keys: Sequence[str]) -> Column:
    """A JSON object of some keys in the order of their names, for comparing and hashing; absent keys are left out."""
    return F.to_json(F.struct(*(F.get_json_object(c, f"$['{k}']").alias(k) for k in sorted(keys))))


def any_given(*cs: Column) -> Column:
    """Whether any of several fields says something: texts that aren't blank, numbers over 0."""
    said = F.lit(False)
    for c in cs:
        text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
        number = text.try_cast("double")
        said = said | F.when(number.isNotNull(), number > 0).otherwise(text != "")
    return said


def option(c: Column, kind: str, default: object = None) -> Column:
    """An option's text as a boolean, int, float or list, or the default; a blank text is no value."""
    text = F.nullif(F.trim(c), F.lit(""))
    if kind == "list":
        return F.when(text.isNotNull(), split_names(text))
    read = truth(text) if kind == "boolean" else text.try_cast("double").cast("int") if kind == "int" else text.try_cast("double")
    return F.coalesce(read, F.lit(default).cast("boolean" if kind == "boolean" else "int" if kind == "int" else "double"))
