"""Drafts against what is managed, filters with errors, lookups by name, states and options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..operators import dedup, entities, filters, replies, runs, sync
from .registry import query, t


def _saved(spark, d):
    k = F.col("n_nationkey")
    text = F.when(k % 5 == 0, F.concat(F.lit('tags.name IN ["'), "n_name", F.lit('", "nowhere, at all"] and tools.id contains_any [1]'))).when(k % 5 == 1, 'colour.name IN ["red"] AND tags.name IN []').when(k % 5 == 2, "anything goes").when(k % 5 == 3, "").otherwise('tags.id NOT IN ["1"]')
    return t(spark, d, "nation").select("n_nationkey", text.alias("filter"))


@query("""SELECT n_nationkey, 'unknown_name' AS error, 'nowhere, at all' AS part FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, 'unknown_name', n_name FROM nation WHERE n_nationkey % 10 = 5
    UNION ALL SELECT n_nationkey, 'unknown_field', 'colour.name IN ["red"]' FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT n_nationkey, 'no_values', 'tags.name IN []' FROM nation WHERE n_nationkey % 5 = 1
    UNION ALL SELECT n_nationkey, 'not_a_clause', 'anything goes' FROM nation WHERE n_nationkey % 5 = 2""")
def filter_errors(spark, d):
    known = t(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.lit("tags").alias("field"), F.col("n_name").alias("name"))
    return filters.errors(_saved(spark, d), "n_nationkey", "filter", known)


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'tags.name IN ["' || s_name || '", "b"]' WHEN 1 THEN 'tools.id CONTAINS ALL ["' || s_nationkey || '"]' WHEN 2 THEN 'recipe_category.name IN ["' || s_name || '"]' ELSE '' END AS shown FROM supplier""")
def filters_lenient(spark, d):
    """Filters as an editor shows them: parts that it doesn't know are dropped."""
    k, name = F.col("s_suppkey") % 4, F.col("s_name")
    text = F.when(k == 0, F.concat(F.lit('tags.name LIKE ["'), name, F.lit('", "b"] AND colour.name IN ["red"]'))).when(k == 1, F.concat(F.lit("tools.id contains all ['"), F.col("s_nationkey").cast("string"), F.lit("'] and nonsense"))).when(
        k == 2, F.concat(F.lit("recipeCategory.name contains any ["), name, F.lit("]"))).otherwise("none of it")
    return t(spark, d, "supplier").select("s_suppkey", filters.shown_leniently(text).alias("shown"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_partkey % 3 <> 0 AS ok, coalesce(sum(CAST(p_partkey % 3 <> 0 AS INT)) OVER (ORDER BY p_name, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM part) SELECT p_partkey, ok FROM p WHERE done < 30""")
def actions_capped(spark, d):
    """Actions in their order until thirty have succeeded."""
    plan = t(spark, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 3 != 0).alias("ok"))
    return dedup.capped(plan, ["p_name", "p_partkey"], F.col("ok"), 30).select("p_partkey", "ok")


_STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'canceled' END"


@query(f"""WITH s AS (SELECT user_id, event_id, {_STATE} AS after, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT * FROM s WHERE before IS NOT NULL AND before <> after AND NOT (before = 'queued' AND after IN ('running', 'canceled') OR before = 'running' AND after IN ('succeeded', 'failed', 'canceled'))""")
def bad_transitions(spark, d):
    return runs.bad_transitions(t(spark, d, "events").withColumn("s", F.expr(_STATE)), "user_id", "event_id", "s")


_VERSIONS = """a AS (SELECT p_brand, p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_brand, p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 1)"""


def _versions(spark, d):
    part = t(spark, d, "part")
    return part.filter("p_partkey % 10 <> 0"), part.filter("p_partkey % 10 <> 1").withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))


@query(f"""WITH {_VERSIONS} SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, count(a.p_partkey) AS draft, count(b.p_partkey) AS managed, count(*) FILTER (a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size IS DISTINCT FROM b.p_size) AS changed
    FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.p_partkey = b.p_partkey GROUP BY 1""")
def resource_counts(spark, d):
    return sync.resource_counts(*_versions(spark, d), "p_brand", "p_partkey", ["p_name", "p_size"])


@query("""WITH a AS (SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS x FROM nation GROUP BY 1), b AS (SELECT n_regionkey, string_agg(CASE WHEN n_nationkey = 7 THEN 'Other' ELSE n_name END, ',' ORDER BY CASE WHEN n_regionkey = 3 THEN -n_nationkey ELSE n_nationkey END) AS x FROM nation WHERE n_regionkey <> 4 GROUP BY 1)
    SELECT a.n_regionkey, a.x IS DISTINCT FROM b.x AS dirty FROM a LEFT JOIN b ON a.n_regionkey = b.n_regionkey""")
def dirty_resources(spark, d):
    nation = t(spark, d, "nation").withColumn("place", F.col("n_nationkey"))
    other = nation.filter("n_regionkey <> 4").withColumn("n_name", F.when(F.col("n_nationkey") == 7, "Other").otherwise(F.col("n_name"))).withColumn("place", F.when(F.col("n_regionkey") == 3, -F.col("place")).otherwise(F.col("place")))
    return sync.dirty(nation, other, "n_regionkey", "place", ["n_name"])


@query("SELECT p_name AS name, max(p_partkey) AS id FROM part GROUP BY 1")
def ids_by_name(spark, d):
    part = t(spark, d, "part").withColumn("n", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.col("p_name")))
    return entities.ids_by_name(part, "n", "p_partkey", "p_partkey")


@query("""WITH w AS (SELECT DISTINCT p_brand, upper(p_name) AS name FROM part WHERE p_size > 40 UNION ALL SELECT 'Brand#1', 'Nowhere')
    SELECT w.p_brand, w.name, min(p.p_partkey) AS id FROM w LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) p ON p.p_brand = w.p_brand AND lower(p.p_name) = lower(w.name) GROUP BY 1, 2""")
def names_looked_up(spark, d):
    part = t(spark, d, "part")
    wanted = part.filter("p_size > 40").select("p_brand", F.upper("p_name").alias("name")).distinct().unionByName(spark.createDataFrame([("Brand#1", "Nowhere")], "p_brand string, name string"))
    return entities.lookup(part.filter("p_size <= 40"), wanted, "p_name", "p_partkey", "p_brand")


@query("""WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS food FROM lineitem UNION ALL SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R') SELECT food, count(*) AS usage FROM a GROUP BY 1""")
def nested_usage(spark, d):
    """Ids that stand in either of two arrays of a record."""
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("a"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey").cast("string")).otherwise("")).alias("b"))
    return dedup.nested_usage(rows, [F.col("a"), F.col("b")], "food")


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS timed, o_orderkey % 4 = 1 AS yields FROM orders""")
def fields_present(spark, d):
    """Whether any time field, or any yield field, says something."""
    k = F.col("o_orderkey")
    timed = checks.any_given(F.when(k % 3 == 0, "10 min"), F.lit(" "), F.when(k % 5 == 0, "PT5M"))
    return t(spark, d, "orders").select("o_orderkey", timed.alias("timed"), checks.any_given(F.lit(""), F.when(k % 4 == 1, 2.5).otherwise(0.0), F.lit(None).cast("string")).alias("yields"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS flag, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey WHEN 1 THEN 5 ELSE 5 END AS size, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey + 0.5::DOUBLE END AS share, CASE WHEN n_nationkey % 3 = 0 THEN 'a|b' END AS names FROM nation""")
def typed_options(spark, d):
    k = F.col("n_nationkey")
    pick = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    return t(spark, d, "nation").select(
        "n_nationkey", checks.option(pick(" Yes ", "off", "perhaps"), "boolean", True).alias("flag"), checks.option(pick(k.cast("string"), "x", " "), "int", 5).alias("size"),
        checks.option(pick(F.concat(k.cast("string"), F.lit(".5")), "", "y"), "float").alias("share"), F.array_join(checks.option(pick("a, b;", " ", None), "list"), "|").alias("names"),
    )


@query("""SELECT 'You are a tagger. For each record give' || chr(10) || '- tags: only from the list below; an empty list if nothing fits' || chr(10) || 'as a JSON array like [{"tags": ["A"]}] and nothing else.' || chr(10) || chr(10) || 'Tags:' || chr(10)
    || string_agg('- ' || p_brand, chr(10) ORDER BY '- ' || p_brand) || chr(10) || chr(10) || 'Records:' AS prompt FROM (SELECT DISTINCT p_brand FROM part)""")
def prompt_instruction(spark, d):
    """What a prompt for one field asks for, with the names to choose from."""
    listing = replies.choices(t(spark, d, "part"), "p_brand").first().listing  # a list that fits a prompt
    return spark.createDataFrame([(replies.instruction("tagger", {"tags": listing}, '{"tags": ["A"]}'),)], "prompt string")


@query("""SELECT option FROM (SELECT DISTINCT p_brand AS option FROM part) WHERE option NOT IN ('Brand#1', 'Brand#2')""")
def unknown_options(spark, d):
    allowed = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#99",)], "option string")
    return t(spark, d, "part").select(F.col("p_brand").alias("option")).subtract(allowed)
