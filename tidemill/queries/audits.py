"""Completeness, coverage, usage and names of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, taxonomy
from ..operators.dedup import usage
from .registry import SCORED, TIER, checks, query, records, t

_MISSING = """array_to_string(list_filter([CASE WHEN NOT c1 THEN 'category' END, CASE WHEN NOT c2 THEN 'tags' END, CASE WHEN NOT c3 THEN 'tools' END,
    CASE WHEN NOT c4 THEN 'description' END, CASE WHEN NOT c5 THEN 'time' END, CASE WHEN NOT c6 THEN 'yield' END], lambda x: x IS NOT NULL), ',')"""


def _scores(spark, d):
    return audit.scored(records(spark, d), checks())


@query(f"{SCORED} SELECT o_orderkey, n_parts, n_suppliers, n_flags, score, {TIER} AS tier FROM scored")
def quality_scores(spark, d):
    return _scores(spark, d).select("o_orderkey", "n_parts", "n_suppliers", "n_flags", "score", "tier")


@query(f"{SCORED} SELECT o_orderkey, {_MISSING} AS missing FROM scored WHERE score < 6")
def missing_dimensions(spark, d):
    return _scores(spark, d).filter("score < 6").select("o_orderkey", F.array_join("missing", ",").alias("missing"))


@query(f"""{SCORED} SELECT CAST(i AS INT) AS score, coalesce(n, 0) AS n, CASE WHEN i >= 5 THEN 'gold' WHEN i >= 3 THEN 'silver' ELSE 'bronze' END AS tier
    FROM range(7) r(i) LEFT JOIN (SELECT score, count(*) AS n FROM scored GROUP BY score) s ON s.score = i""")
def score_distribution(spark, d):
    return audit.distribution(_scores(spark, d), 6)


@query(f"{SCORED} SELECT {TIER} AS tier, count(*) AS n, CAST(min(score) AS INT) AS least, CAST(max(score) AS INT) AS most FROM scored GROUP BY 1")
def quality_tiers(spark, d):
    return _scores(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(f"""{SCORED}, h AS (SELECT count(*) AS total, unnest(['category', 'tags', 'tools', 'description', 'time', 'yield']) AS dimension,
        unnest([count(*) FILTER (c1), count(*) FILTER (c2), count(*) FILTER (c3), count(*) FILTER (c4), count(*) FILTER (c5), count(*) FILTER (c6)]) AS hits FROM scored)
    SELECT dimension, hits, total, total - hits AS missing, round_even(hits * 100.0::DOUBLE / greatest(total, 1), 1) AS pct,
        round_even((total - hits) * 100.0::DOUBLE / greatest(total, 1), 1) AS pct_missing FROM h""")
def dimension_coverage(spark, d):
    return audit.coverage(_scores(spark, d), list(checks()))


@query(f"{SCORED} SELECT o_orderkey, score, {_MISSING} AS missing FROM scored ORDER BY score, o_orderkey LIMIT 20")
def worst_records(spark, d):
    return audit.worst(_scores(spark, d), "o_orderkey").select("o_orderkey", "score", F.array_join("missing", ",").alias("missing"))


@query(f"{SCORED} SELECT o_orderkey, score, {_MISSING} AS missing FROM scored WHERE score = 5 ORDER BY o_orderkey LIMIT 50")
def almost_complete(spark, d):
    return audit.almost(_scores(spark, d), "o_orderkey", 6).select("o_orderkey", "score", F.array_join("missing", ",").alias("missing"))


@query("""WITH s AS (SELECT * FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 200), c AS (SELECT count(*) AS sampled, count(*) FILTER (o_totalprice > 250000) AS present FROM s)
    SELECT sampled, present, round_even(present * 100.0::DOUBLE / greatest(sampled, 1), 1) AS pct, CAST(floor((1 - present / greatest(sampled, 1)) * (SELECT count(*) FROM orders)) AS BIGINT) AS estimated_missing FROM c""")
def sampled_estimate(spark, d):
    """A sample of 200 records by hash, and how many records would lack what the sample lacks."""
    orders = t(spark, d, "orders")
    return audit.estimated_missing(audit.sampled(orders, "o_orderkey", 200), F.col("o_totalprice") > 250000, orders.count())


@query("""SELECT p_partkey, p_name, coalesce(usage, 0) AS usage FROM part
    LEFT JOIN (SELECT l_partkey, count(*) AS usage FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey""")
def usage_with_zero(spark, d):
    return taxonomy.with_usage(t(spark, d, "part"), t(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey").select("p_partkey", "p_name", "usage")


def _named_usage(spark, d):
    """Part names as tags, used by the lines of their parts; a few longer, noisy and unused ones beside them."""
    names = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    used = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    by_name = names.join(used, "p_partkey", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("usage"))
    extra = spark.createDataFrame([("best recipe ever", 5), ("how to make bread from scratch", 0), ("Red-Ring", 1), ("red ring", 0)], "name string, usage long")
    return by_name.unionByName(extra.select("name", "usage"))


_NAMED = """WITH used AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
    named AS (SELECT p_name AS name, CAST(coalesce(sum(n), 0) AS BIGINT) AS usage FROM part LEFT JOIN used ON l_partkey = p_partkey GROUP BY 1
        UNION ALL SELECT * FROM (VALUES ('best recipe ever', 5), ('how to make bread from scratch', 0), ('Red-Ring', 1), ('red ring', 0)) v(name, usage))"""
_NOISY = r"regexp_matches(lower(name), '\brecipe\b|\bhow to make\b|\bfrom scratch\b|\bwithout drippings\b|\bfrom drippings\b')"


@query(f"""{_NAMED}, r AS (SELECT name, usage, array_to_string(list_filter([CASE WHEN length(name) >= 11 THEN 'name_too_long' END, CASE WHEN usage < 700 THEN 'low_usage' END,
        CASE WHEN {_NOISY} THEN 'noisy_or_over_specific' END], lambda x: x IS NOT NULL), ',') AS reasons FROM named)
    SELECT * FROM r WHERE reasons <> ''""")
def problem_names(spark, d):
    return taxonomy.problems(_named_usage(spark, d), "name", 11, 700).withColumn("reasons", F.array_join("reasons", ","))


@query(f"{_NAMED} SELECT name, usage FROM named WHERE usage < 700 OR length(name) >= 24 OR {_NOISY}")
def names_to_delete(spark, d):
    return taxonomy.to_delete(_named_usage(spark, d), "name", 24, 700, True)


@query(f"""{_NAMED} SELECT DISTINCT trim(name) AS name FROM named WHERE NOT (length(name) > 24 OR usage < 700 OR lower(name) LIKE '%recipe%' OR lower(name) LIKE '%how to make%'
    OR lower(name) LIKE '%from scratch%' OR lower(name) LIKE '%without drippings%' OR lower(name) LIKE '%from drippings%') AND trim(name) <> ''""")
def prompt_names(spark, d):
    return taxonomy.prompt_candidates(_named_usage(spark, d), "name", 24, 700)


@query(f"""{_NAMED}, g AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, list_sort(list(DISTINCT trim(name))) AS m FROM named WHERE trim(name) <> '' GROUP BY 1)
    SELECT key, array_to_string(m, ',') AS members, CAST(len(m) AS INT) AS n FROM g WHERE len(m) > 1""")
def similar_groups(spark, d):
    return taxonomy.similar(_named_usage(spark, d), "name").select("key", F.array_join("members", ",").alias("members"), "n")


@query("""SELECT p_brand, count(*) AS "count", CAST(round_even(count(*) * 100.0::DOUBLE / greatest((SELECT count(*) FROM lineitem), 1), 0) AS INT) AS pct
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def overview_top6(spark, d):
    lines = t(spark, d, "lineitem")
    return taxonomy.top_shares(lines.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), "p_brand", lines.count())


@query("""SELECT count(*) AS total, count(*) FILTER (NOT o_totalprice > 100000) AS without_price, count(*) FILTER (NOT o_orderpriority <> '4-NOT SPECIFIED') AS without_priority FROM orders""")
def filed_counts(spark, d):
    return taxonomy.filed(t(spark, d, "orders"), {"price": F.col("o_totalprice") > 100000, "priority": F.col("o_orderpriority") != "4-NOT SPECIFIED"})


@query("""WITH r AS (SELECT p_partkey AS "index", lower(trim(coalesce(CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE p_name END, ''))) AS key FROM part),
    f AS (SELECT key, min("index") AS first_index FROM r WHERE key <> '' GROUP BY 1)
    SELECT "index", CASE WHEN r.key = '' THEN 'missing_name' ELSE 'duplicate_name' END AS error, CASE WHEN r.key <> '' THEN first_index END AS first_index
    FROM r LEFT JOIN f ON r.key = f.key WHERE r.key = '' OR "index" > first_index""")
def name_errors(spark, d):
    part = t(spark, d, "part").withColumn("name", F.when(F.col("p_partkey") % 97 == 0, F.lit(" ")).otherwise(F.col("p_name")))
    return taxonomy.duplicate_names(part, "name", "p_partkey")


@query("SELECT l_partkey, count(*) AS usage FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1")
def foods_usage(spark, d):
    return usage(t(spark, d, "lineitem"), "l_partkey")


@query("""SELECT 'region' AS "table", count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier
    UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events""")
def entity_counts(spark, d):
    counted = [t(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n") for n in ("region", "nation", "supplier", "customer", "events")]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out
