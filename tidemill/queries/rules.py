"""Rules and saved filters over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..operators import rules as R
from ..operators.rules import Rule
from .registry import SQL, query, records, t

_TEXT_RULES = [
    Rule("text_tags", "Metal", r"\b(bolt|gear|anvil)s?\b", ascii=True), Rule("text_tags", "Cold", "cold", match_on="name"), Rule("text_tags", "Promo", "promo", match_on="description"),
    Rule("text_categories", "Rings", r"\bring\b", exclude="red|old", ascii=True), Rule("text_tags", "Off", "small", enabled=False), Rule("text_tags", "Broken", "(small"),
]


@query(r"""SELECT p_partkey, 'text_tags' AS section, 'Metal' AS target FROM part WHERE regexp_matches(p_name, '\b(bolt|gear|anvil)s?\b', 'i') OR regexp_matches(p_type, '\b(bolt|gear|anvil)s?\b', 'i')
    UNION ALL SELECT p_partkey, 'text_tags', 'Cold' FROM part WHERE regexp_matches(p_name, 'cold', 'i') UNION ALL SELECT p_partkey, 'text_tags', 'Promo' FROM part WHERE regexp_matches(p_type, 'promo', 'i')
    UNION ALL SELECT p_partkey, 'text_categories', 'Rings' FROM part WHERE (regexp_matches(p_name, '\bring\b', 'i') OR regexp_matches(p_type, '\bring\b', 'i')) AND NOT regexp_matches(p_name || '|' || p_type, 'red|old', 'i')""")
def rule_text_match(spark, d):
    return R.text_matches(t(spark, d, "part"), _TEXT_RULES, "p_partkey", "p_name", "p_type")


_PART_RULES = [Rule("ingredient_tags", "Blue twice", r"\bblue\b", min_matches=2, ascii=True), Rule("ingredient_categories", "Any rod", "rod", exclude="old")]
_PART_HITS = r"""l AS (SELECT DISTINCT l_orderkey, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
    hits AS (SELECT l_orderkey, 'ingredient_tags' AS section, 'Blue twice' AS target FROM l WHERE regexp_matches(p_name, '\bblue\b', 'i') GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2
        UNION ALL SELECT DISTINCT l_orderkey, 'ingredient_categories', 'Any rod' FROM l WHERE regexp_matches(p_name, 'rod', 'i') AND NOT regexp_matches(p_name, 'old', 'i'))"""


def _part_hits(spark, d):
    lines, part = t(spark, d, "lineitem"), t(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    return R.part_matches(lines, part, _PART_RULES, "l_orderkey", "l_partkey", "p_name")


@query(f"WITH {_PART_HITS} SELECT * FROM hits")
def rule_min_matches(spark, d):
    return _part_hits(spark, d)


@query(f"WITH {_PART_HITS} SELECT section, target, count(DISTINCT l_orderkey) AS matched FROM hits GROUP BY 1, 2")
def rule_counts(spark, d):
    return R.matched_counts(_part_hits(spark, d), "l_orderkey")


@query(f"WITH {_PART_HITS} SELECT DISTINCT l_orderkey, target FROM hits WHERE NOT (target = 'Any rod' AND l_orderkey % 3 = 0)")
def rule_new_links(spark, d):
    linked = t(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("Any rod").alias("target"))
    return R.new_links(_part_hits(spark, d), linked, "l_orderkey")


@query(r"""SELECT DISTINCT 'tool_tags' AS section, p_name AS target, '\b' || replace(p_name, ' ', '[\s_-]+') || '\b' AS pattern, 'both' AS match_on FROM part
    UNION ALL SELECT 'text_categories', n_name, '\b' || replace(n_name, '_', '[\s_-]+') || '\b', 'name' FROM nation""")
def rules_from_taxonomy(spark, d):
    tools = R.rules_from(t(spark, d, "part"), "p_name", "tool_tags")
    return tools.unionByName(R.rules_from(t(spark, d, "nation"), "n_name", "text_categories", "name"))


@query("""WITH r AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS target FROM part
        UNION ALL SELECT 'ghost tag'), k AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name LIKE '%o%')
    SELECT target, name AS known, CASE WHEN name IS NULL THEN 'drop' WHEN name <> target THEN 'rename' ELSE 'keep' END AS action FROM r LEFT JOIN k ON lower(target) = lower(name)""")
def rule_targets(spark, d):
    part = t(spark, d, "part")
    wanted = part.select(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("target")).distinct()
    wanted = wanted.unionByName(spark.createDataFrame([("ghost tag",)], "target string"))
    return R.resolved(wanted, part.filter("p_name LIKE '%o%'").select(F.col("p_name").alias("name"))).select("target", "known", "action")


# --- filters ----------------------------------------------------------------------

_SETS = """WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags, list(DISTINCT CAST(l_suppkey AS VARCHAR)) AS suppliers FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey, coalesce(flags, []) AS flags, coalesce(suppliers, []) AS suppliers FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)"""


def _filtered(spark, d, text):
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set(F.col("l_suppkey").cast("string")).alias("suppliers"))
    clauses, errors = filters.parse(text)
    if errors:
        raise ValueError(errors)
    rows = t(spark, d, "orders").join(lines, "o_orderkey", "left")
    return rows.filter(filters.column(clauses, {"tags": F.col("flags"), "tools": F.col("suppliers")})).select("o_orderkey")


@query(f"{_SETS} SELECT o_orderkey FROM o WHERE list_has_any(suppliers, ['3', '17', '99'])")
def filter_in(spark, d):
    return _filtered(spark, d, 'tools.id CONTAINS ANY ["3", "17", "99"]')


@query(f"{_SETS} SELECT o_orderkey FROM o WHERE NOT list_has_any(flags, ['N'])")
def filter_not_in(spark, d):
    return _filtered(spark, d, 'tags.name NOT IN ["N"]')


@query(f"{_SETS} SELECT o_orderkey FROM o WHERE list_has_all(flags, ['A', 'R']) AND NOT list_has_any(suppliers, ['5', '6'])")
def filter_contains_all(spark, d):
    return _filtered(spark, d, 'tags.name CONTAINS ALL ["A", "R"] AND tools.id NOT IN [5, \'6\']')


def _divided(spark, d, text):
    clauses, errors = filters.parse(text)
    if errors:
        raise ValueError(errors)
    lines = t(spark, d, "lineitem")
    return filters.divided(t(spark, d, "orders"), "o_orderkey", clauses, {"tags": (lines, "l_orderkey", "l_returnflag"), "tools": (lines, "l_orderkey", "l_suppkey")}).select("o_orderkey")


@query(SQL["filter_contains_all"])
def filter_divided(spark, d):
    """The same filter without any gathered values."""
    return _divided(spark, d, 'tags.name CONTAINS ALL ["A", "R"] AND tools.id NOT IN [5, \'6\']')


@query(f"{_SETS} SELECT o_orderkey FROM o WHERE NOT list_has_any(flags, ['N']) AND list_has_any(suppliers, ['3', '17', '99', 'none'])")
def filter_divided_in(spark, d):
    return _divided(spark, d, 'tags.name NOT IN ["N"] AND tools.id IN ["3", "17", "99", "none"]')


@query(r"""WITH n AS (SELECT lower(n_name) AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation)
    SELECT 0 AS id, 'tags.name IN ["NATION_1", "nation_2"]' AS filter, 'tags.id IN ["' || (SELECT id FROM n WHERE name = 'nation_1') || '", "' || (SELECT id FROM n WHERE name = 'nation_2') || '"]' AS compiled, '' AS errors
    UNION ALL SELECT 1, 'tags.name contains  all ["NATION_3"] AND tools.name IN ["x"]', 'tags.id CONTAINS ALL ["' || (SELECT id FROM n WHERE name = 'nation_3') || '"] AND tools.name IN ["x"]', ''
    UNION ALL SELECT 2, 'tags.name NOT IN ["NATION_1", "nowhere"]', 'tags.name NOT IN ["NATION_1", "nowhere"]', '' UNION ALL SELECT 3, 'recipeCategory.id IN ["1"]', 'recipeCategory.id IN ["1"]', ''""")
def filters_compiled(spark, d):
    """Saved filters with names, and as they read with ids."""
    ids = {"tags": {r["n_name"].lower(): str(r["n_nationkey"]) for r in t(spark, d, "nation").collect()}}  # a small table that names nations
    rows = ['tags.name IN ["NATION_1", "nation_2"]', 'tags.name contains  all ["NATION_3"] AND tools.name IN ["x"]', 'tags.name NOT IN ["NATION_1", "nowhere"]', "recipeCategory.id IN [\"1\"]"]
    return spark.createDataFrame([(i, x, filters.with_ids(x, ids), "; ".join(filters.parse(x)[1])) for i, x in enumerate(rows)], "id int, filter string, compiled string, errors string")


@query("""SELECT n_nationkey, 'tags' AS field, v AS value FROM (SELECT n_nationkey, unnest([n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'nowhere' ELSE 'region_' || n_regionkey END]) AS v FROM nation)
    WHERE lower(v) NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 20)""")
def filter_unknown_values(spark, d):
    nation = t(spark, d, "nation")
    other = F.when(F.col("n_nationkey") % 4 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")))
    saved = nation.select("n_nationkey", F.concat(F.lit('tags.name IN ["'), "n_name", F.lit('", "'), other, F.lit('"]')).alias("filter"))
    known = nation.filter("n_nationkey < 20").select(F.lit("tags").alias("field"), F.col("n_name").alias("name"))
    return filters.unknown_values(saved, "n_nationkey", "filter", known)


@query("""WITH n AS (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey FROM orders LEFT JOIN n USING (o_orderkey) WHERE coalesce(n, 0) = 0 OR o_orderpriority = '4-NOT SPECIFIED'""")
def missing_any(spark, d):
    """Records that lack tags or a description."""
    return records(spark, d).filter((F.col("n_parts") == 0) | (F.col("o_orderpriority") == "4-NOT SPECIFIED")).select("o_orderkey")


@query(r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS name FROM benchmark),
    w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS word FROM documents)
    SELECT name AS target, count(*) AS matched FROM w JOIN n ON word = name GROUP BY 1""")
def rules_many(spark, d):
    """Every word of the benchmark as a rule, thousands of them, over the documents."""
    names = t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))).alias("name"))
    made = [Rule(r["section"], r["target"], r["pattern"]) for r in R.rules_from(names, "name", "text_tags").collect()]  # rules are what an editor keeps
    found = R.text_matches(t(spark, d, "documents").select("doc_id", "text", F.lit("").alias("none")), made, "doc_id", "text", "none")
    return R.matched_counts(found, "doc_id").select("target", "matched")
