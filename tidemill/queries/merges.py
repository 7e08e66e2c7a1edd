"""Duplicates, keepers, merge plans and their application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical_url, name_key, numeric_suffix
from ..operators import dedup
from .registry import query, t

_KEY = r"lower(trim(regexp_replace(p_name, '\s+', ' ', 'g')))"


def _foods(spark, d):
    return t(spark, d, "part").withColumn("key", name_key(F.col("p_name")))


def _plan(spark, d):
    counts = dedup.usage(t(spark, d, "lineitem"), "l_partkey").withColumnRenamed("l_partkey", "p_partkey")
    return dedup.merge_plan(_foods(spark, d), ["p_brand", "key"], "p_partkey", "p_name", counts)


_PLAN = f"""WITH used AS (SELECT l_partkey, count(*) AS usage FROM lineitem GROUP BY 1),
    ranked AS (SELECT p_brand, {_KEY} AS key, p_partkey, p_name, coalesce(usage, 0) AS usage,
        first_value(p_partkey) OVER w AS target_id, first_value(p_name) OVER w AS target_name, first_value(coalesce(usage, 0)) OVER w AS target_usage
        FROM part LEFT JOIN used ON l_partkey = p_partkey WINDOW w AS (PARTITION BY p_brand, {_KEY} ORDER BY coalesce(usage, 0) DESC, p_partkey)),
    plan AS (SELECT p_brand, key, p_partkey AS source_id, p_name AS source_name, target_id, target_name, usage AS source_usage, target_usage FROM ranked WHERE p_partkey <> target_id)"""


@query(f"SELECT p_brand, {_KEY} AS key, count(*) AS n, min(p_partkey) AS least FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def foods_duplicate_groups(spark, d):
    return dedup.duplicates(_foods(spark, d), ["p_brand", "key"]).groupBy("p_brand", "key").agg(F.max("n").alias("n"), F.min("p_partkey").alias("least"))


@query(f"{_PLAN} SELECT * FROM plan")
def foods_merge_plan(spark, d):
    return _plan(spark, d)


@query(f"""{_PLAN} SELECT coalesce(target_id, l_partkey) AS l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders
    FROM lineitem LEFT JOIN plan ON source_id = l_partkey GROUP BY 1""")
def fk_rewrite(spark, d):
    moved = dedup.rewritten(t(spark, d, "lineitem"), _plan(spark, d), "l_partkey")
    return moved.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@query(f"{_PLAN} SELECT p_partkey, p_brand, p_name FROM part WHERE p_partkey NOT IN (SELECT source_id FROM plan)")
def foods_after_merge(spark, d):
    return dedup.without(t(spark, d, "part"), _plan(spark, d), "p_partkey").select("p_partkey", "p_brand", "p_name")


@query(f"{_PLAN} SELECT * FROM plan WHERE source_id % 5 <> 0 ORDER BY key, p_brand, source_id LIMIT 40")
def merge_plan_capped(spark, d):
    """The first 40 actions of the plan's order that a checkpoint doesn't list."""
    done = t(spark, d, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("source_id"))
    return _plan(spark, d).join(done, "source_id", "left_anti").orderBy("key", "p_brand", "source_id").limit(40)


@query("""SELECT s_nationkey, s_suppkey AS source_id, s_name AS source_name, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS target_id FROM supplier
    QUALIFY s_suppkey <> min(s_suppkey) OVER (PARTITION BY s_nationkey)""")
def tools_min_id_merge(spark, d):
    return dedup.merge_plan(t(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", "s_name").select("s_nationkey", "source_id", "source_name", "target_id")


_ALIASES = [("nation_1", "nation_2"), ("nation_3", "nation_4"), ("nation_5", "nation_5"), ("nation_7", "no such")]
_ALIAS_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _ALIASES)


@query(f"""WITH a AS (SELECT * FROM (VALUES {_ALIAS_VALUES}) v(alias, canonical)), k AS (SELECT n_nationkey, lower(trim(n_name)) AS key, n_regionkey FROM nation),
    both_plans AS (SELECT s.n_nationkey AS source_id, c.n_nationkey AS target_id, 'alias_map' AS reason FROM k s JOIN a ON s.key = a.alias JOIN k c ON c.key = a.canonical WHERE s.n_nationkey <> c.n_nationkey
        UNION ALL SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey), 'same_name' FROM nation)
    SELECT source_id, target_id, reason FROM both_plans WHERE source_id <> target_id QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY reason <> 'alias_map', target_id) = 1""")
def units_alias_merge(spark, d):
    units = t(spark, d, "nation").withColumn("key", name_key(F.col("n_name")))
    aliases = spark.createDataFrame(_ALIASES, "alias string, canonical string")
    by_name = dedup.merge_plan(units, ["n_regionkey"], "n_nationkey", "n_name")
    return dedup.alias_plan(units, aliases, "n_nationkey", "key", by_name)


@query("""SELECT alias, array_to_string(list_sort(list(DISTINCT canonical)), ',') AS canonicals FROM (SELECT p_name AS alias, p_type AS canonical FROM part) GROUP BY 1 HAVING count(DISTINCT canonical) > 1""")
def alias_conflicts(spark, d):
    aliases = t(spark, d, "part").select(F.col("p_name").alias("alias"), F.col("p_type").alias("canonical"))
    return dedup.alias_conflicts(aliases).select("alias", F.array_join("canonicals", ",").alias("canonicals"))


@query()
def similar_names(spark, d):
    """Names of parts and their misspelt forms (a letter dropped) that are alike within a brand."""
    part = t(spark, d, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    worn = part.select("p_brand", F.col("p_partkey") + 1_000_000_000, F.regexp_replace("name", "[aeiou](?=[^aeiou]*$)", "")).toDF("p_brand", "p_partkey", "name")
    return dedup.similar_names(part.unionByName(worn), "p_brand", "p_partkey", "name").select("p_brand", "a", "b", "similarity").orderBy(F.desc("similarity"), "a", "b")


# SQL for canonical_url, as far as the pages' addresses need it.
_URL = r"""(regexp_extract(url, '^([a-z]+)://', 1) || '://' || ltrim(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'w.')
    || coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '(.)/$', '\1'), ''), '/')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
        lambda p: regexp_matches(p, '^[^=]*=.') AND NOT regexp_matches(p, '^(utm_source|utm_medium|ref)='))), '&'), ''), ''))"""


@query(f"SELECT page_id, {_URL} AS canonical FROM pages")
def url_canonical(spark, d):
    return t(spark, d, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


@query(f"""WITH p AS (SELECT page_id, url, {_URL} AS canonical FROM pages),
    g AS (SELECT *, count(*) OVER (PARTITION BY canonical) AS n, first_value(page_id) OVER (PARTITION BY canonical ORDER BY -length(url), page_id) AS keeper FROM p)
    SELECT canonical, page_id, keeper, page_id = keeper AS kept FROM g WHERE n > 1""")
def url_dedup_keeper(spark, d):
    pages = t(spark, d, "pages").withColumn("canonical", canonical_url(F.col("url")))
    return dedup.keepers(pages, ["canonical"], [-F.length("url")], "page_id").select("canonical", "page_id", "keeper", "kept")


@query(r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN url || ' (2)' ELSE url END AS name, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages),
    g AS (SELECT *, count(*) OVER (PARTITION BY host) AS n, first_value(page_id) OVER (PARTITION BY host ORDER BY CAST(regexp_matches(name, '\(\d+\)$') AS INT), -length(name), -length(url), page_id) AS keeper FROM p)
    SELECT host, page_id, keeper, page_id = keeper AS kept FROM g WHERE n > 1 AND host <> ''""")
def host_keeper(spark, d):
    pages = t(spark, d, "pages").withColumn("name", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(" (2)"))).otherwise(F.col("url")))
    pages = pages.withColumn("host", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)))
    return dedup.keepers(pages, ["host"], dedup.name_rank("name", "url"), "page_id").select("host", "page_id", "keeper", "kept")


@query(r"SELECT count(*) FILTER (regexp_matches(n, '\(\d+\)$')) AS suffixed, count(*) AS total FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_name || ' (' || p_size || ')' ELSE p_name END AS n FROM part)")
def numeric_suffixes(spark, d):
    n = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.col("p_name"))
    return t(spark, d, "part").agg(F.count_if(numeric_suffix(n)).alias("suffixed"), F.count(F.lit(1)).alias("total"))


@query("SELECT user_id, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM events GROUP BY 1")
def first_wins(spark, d):
    return dedup.first_by(t(spark, d, "events"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events QUALIFY rank <= 20")
def newest_per_key(spark, d):
    return dedup.newest(t(spark, d, "events"), "user_id", F.desc("ts"), 20).select("user_id", "event_id", "ts", "rank")
