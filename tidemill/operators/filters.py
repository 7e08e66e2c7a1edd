"""The saved-filter language: clauses ``field.name OP [values]`` joined by AND.

A filter is a few words that the driver reads; what it selects is a Column."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import value_list

# Fields by the names that filters use, and operators.
FIELDS = {"recipecategory": "recipe_category", "recipe_category": "recipe_category", "tags": "tags", "tools": "tools", "recipeingredient.food": "recipe_ingredient.food"}
OPERATORS = ("IN", "NOT IN", "CONTAINS ALL")
_CLAUSE = re.compile(r"^\s*(?P<field>[A-Za-z_.]+)\.(?P<attribute>name|id)\s+(?P<op>NOT\s+IN|IN|CONTAINS\s+ALL)\s*\[(?P<values>[^\]]*)\]\s*$", re.IGNORECASE)


@dataclass(frozen=True)
class Clause:
    field: str
    attribute: str
    op: str
    values: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.field}.{self.attribute} {self.op} [{', '.join(json.dumps(v, ensure_ascii=False) for v in self.values)}]"


def normalized(text: str) -> str:
    """Single spaces, and IN for CONTAINS ANY."""
    return " ".join(re.sub(r"\bCONTAINS[_ ]ANY\b", "IN", text or "", flags=re.IGNORECASE).split())


def values(text: str) -> list[str]:
    """What stands between the brackets: JSON strings, else texts between commas without their quotes."""
    try:
        found = [v for v in json.loads(f"[{text}]") if isinstance(v, str)]
    except ValueError:
        found = [v.strip().strip("\"'") for v in text.split(",")]
    return [" ".join(v.split()) for v in found if v.strip()]


def parse(text: str) -> tuple[list[Clause], list[str]]:
    """The clauses of a filter, and what is wrong with the others.  AND splits wherever white space surrounds it."""
    clauses, errors = [], []
    for part in re.split(r"\s+AND\s+", normalized(text), flags=re.IGNORECASE) if normalized(text) else []:
        m = _CLAUSE.match(part)
        field = FIELDS.get(m["field"].lower()) if m else None
        found = values(m["values"]) if m else []
        if not m:
            errors.append(f"not a clause: {part}")
        elif not field:
            errors.append(f"unknown field: {m['field']}")
        elif not found:
            errors.append(f"no values: {part}")
        else:
            clauses.append(Clause(field, m["attribute"].lower(), " ".join(m["op"].upper().split()), tuple(found)))
    return clauses, errors


def with_ids(text: str, ids: Mapping[str, Mapping[str, str]]) -> str:
    """The filter with lists of names as lists of ids (``ids``: field to name in lower case to id); a clause with a name
    that isn't known stays as it is."""
    out = []
    for part in re.split(r"\s+AND\s+", normalized(text), flags=re.IGNORECASE):
        clauses, errors = parse(part)
        if errors or not clauses:
            out.append(part)
            continue
        c = clauses[0]
        known = [ids.get(c.field, {}).get(v.lower()) for v in c.values]
        out.append(str(Clause(c.field, "id", c.op, tuple(known))) if c.attribute == "name" and all(known) else part)
    return " AND ".join(out)


def column(clauses: list[Clause], arrays: Mapping[str, Column]) -> Column:
    """Which records a filter selects; ``arrays`` gives the array column of each field (null counts as empty)."""
    held = F.lit(True)
    for c in clauses:
        have = F.coalesce(arrays[c.field], F.array().cast("array<string>"))
        wanted = F.array(*map(F.lit, c.values))
        test = F.size(F.array_except(wanted, have)) == 0 if c.op == "CONTAINS ALL" else F.arrays_overlap(have, wanted)
        held = held & (~test if c.op == "NOT IN" else test)
    return held


def divided(records: DataFrame, key: str, clauses: list[Clause], links: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """The records that a filter selects, by relational division: ``links`` gives each field's table, with its columns of record keys and
    of values.

    Of a table only the rows with a wanted value are read, and each record's wanted values are bits that map tasks combine, so that
    no record's values are gathered.  Values that aren't of the column's type match nothing.  A record without a key has no links."""
    held = F.lit(True)
    kept = records
    for n, field in enumerate(dict.fromkeys(c.field for c in clauses)):
        table, of, value = links[field]
        kind = table.schema[value].dataType
        own = [c for c in clauses if c.field == field]
        wanted = list(dict.fromkeys(v for c in own for v in c.values))
        typed = {v: F.lit(v).try_cast(kind) for v in wanted}
        words = [wanted[k:k + 62] for k in range(0, len(wanted), 62)]
        masks = []
        for k, word in enumerate(words):
            bit = F.lit(0).cast("long")
            for b, v in enumerate(word):
                bit = F.when(F.col(value) == typed[v], F.lit(1 << b).cast("long")).otherwise(bit)
            masks.append(F.bit_or(bit).alias(f"_m{n}_{k}"))
        found = table.filter(F.col(value).isin(*typed.values())).groupBy(F.col(of).alias(f"_k{n}")).agg(*masks)
        kept = kept.join(found, F.col(key) == F.col(f"_k{n}"), "left")
        for c in own:
            bits = [sum(1 << word.index(v) for v in set(c.values) if v in word) for word in words]
            has = [F.coalesce(F.col(f"_m{n}_{k}"), F.lit(0).cast("long")).bitwiseAND(F.lit(b).cast("long")) for k, b in enumerate(bits)]
            test = reduce(Column.__and__, (h == b for h, b in zip(has, bits))) if c.op == "CONTAINS ALL" else reduce(Column.__or__, (h != 0 for h in has))
            held = held & (~test if c.op == "NOT IN" else test)
    return kept.filter(held).select(*(records[c] for c in records.columns))


def _keyed(filters: DataFrame, key: str, text: str) -> DataFrame:
    if key in ("field", "value", "error", "part"):
        raise ValueError(f"the key is called {key}, as a column of the result is")
    return filters.select(F.col(key).alias("_key"), F.col(text).alias("_text"))


_LISTED = r"([A-Za-z_.]+)\.name\s+(?:NOT\s+IN|IN|CONTAINS\s+ALL)\s*\[([^\]]*)\]"


def _unknown(texts: DataFrame, names: DataFrame, clause: str) -> DataFrame:
    """_key, field and value of the names that aren't known, of the places in ``_text`` that ``clause`` finds."""
    fields, lists = (F.regexp_extract_all(F.col("_text"), F.lit(f"(?i){clause}"), F.lit(k)) for k in (1, 2))
    parts = texts.select("_key", F.explode(F.arrays_zip(fields.alias("field"), lists.alias("list"))).alias("_c"))
    field = F.coalesce(*(F.when(F.lower("_c.field") == k, F.lit(v)) for k, v in FIELDS.items()))
    each = parts.select("_key", field.alias("field"), F.explode(value_list(F.col("_c.list"))).alias("value"))
    known = names.select("field", F.lower(F.trim("name")).alias("_name")).distinct()
    return each.filter("value <> ''").withColumn("_name", F.lower(F.trim("value"))).join(known, ["field", "_name"], "left_anti").select("_key", "field", "value").distinct()


def unknown_values(filters: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """Names in the filters of a table that aren't among ``names`` (field, name): key, field, value.

    The clauses are taken apart by expressions, so a table of very many filters is fine too."""
    return _unknown(_keyed(filters, key, text), names, _LISTED).withColumnRenamed("_key", key)


def names_used(filters: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether any filter refers to names, which need looking up: ``by`` and needed, a row for each ``by``, or one."""
    return filters.groupBy(*by).agg(F.coalesce(F.max(F.col(text).rlike(r"(?i)\b(?:recipe_category|recipeCategory|tags|tools)\.name\b")), F.lit(False)).alias("needed"))


def errors(filters: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """What is wrong with the filters of a table: key, error (not_a_clause, unknown_field, no_values or unknown_name), part.  ``names`` as for
    :func:`unknown_values`.  A filter without any text is fine; names are looked up in parts that are clauses."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("_text", F.lit("")), r"(?i)\bCONTAINS[_ ]ANY\b", "IN"), r"\s+", " "))
    parts = _keyed(filters, key, text).select("_key", F.explode(F.filter(F.split(plain, r"(?i)\s+AND\s+"), lambda p: p != "")).alias("_text"))
    clause = r"(?i)^\s*([A-Za-z_.]+)\.(?:name|id)\s+(?:NOT\s+IN|IN|CONTAINS\s+ALL)\s*\[([^\]]*)\]\s*$"
    field, listed = F.lower(F.regexp_extract("_text", clause, 1)), value_list(F.regexp_extract("_text", clause, 2))
    error = F.when(~F.col("_text").rlike(clause), "not_a_clause").when(~field.isin(list(FIELDS)), "unknown_field").when(F.size(listed) == 0, "no_values")
    wrong = parts.withColumn("error", error).filter("error IS NOT NULL").select("_key", "error", F.col("_text").alias("part"))
    unknown = _unknown(parts, names, rf"^\s*{_LISTED}\s*$").filter("field IS NOT NULL").select("_key", F.lit("unknown_name").alias("error"), F.col("value").alias("part")).distinct()
    return wrong.unionByName(unknown).withColumnRenamed("_key", key)


def lenient(text: str) -> list[Clause]:
    """The clauses of a filter that an editor shows: parts that are none are dropped, and one with an operator that isn't known reads IN."""
    found = []
    for part in re.split(r"\s+AND\s+", normalized(text), flags=re.IGNORECASE):
        m = re.match(r"^\s*([A-Za-z_.]+)\.(name|id)\s+(.*?)\s*\[([^\]]*)\]\s*$", part, re.IGNORECASE)
        field = FIELDS.get(m[1].lower()) if m else None
        if m and field and values(m[4]):
            op = " ".join(m[3].upper().split())
            found.append(Clause(field, m[2].lower(), op if op in OPERATORS else "IN", tuple(values(m[4]))))
    return found


def shown_leniently(text: Column) -> Column:
    """The same for a column of filters, as text."""
    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: " AND ".join(map(str, lenient(x))))
    return shown(F.coalesce(text, F.lit("")))
