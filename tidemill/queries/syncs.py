"""Plans between desired and existing tables, and merges of two sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import plain_slug
from ..operators import renames, sync
from .registry import query, t


def _sides(spark, d):
    nation = t(spark, d, "nation")
    old = nation.filter("n_nationkey < 18")
    new = nation.filter("n_nationkey >= 4").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 5 == 0, F.lit(None).cast("int")).otherwise(F.col("n_regionkey")))
    return old, new


_SIDES = """WITH a AS (SELECT * FROM nation WHERE n_nationkey < 18), b AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey >= 4)"""


@query(f"""{_SIDES} SELECT coalesce(a.n_name, b.n_name) AS n_name, CASE WHEN a.n_name IS NULL THEN 'create' WHEN b.n_name IS NULL THEN 'delete'
    WHEN a.n_regionkey IS NOT DISTINCT FROM b.n_regionkey THEN 'skip' ELSE 'update' END AS action FROM a FULL JOIN b ON a.n_name = b.n_name""")
def sync_replace(spark, d):
    return sync.plan(*_sides(spark, d), "n_name", ["n_regionkey"], replace=True)


@query(f"""{_SIDES}, p AS (SELECT CASE WHEN a.n_name IS NULL THEN 'create' WHEN b.n_name IS NULL THEN 'keep' WHEN a.n_regionkey IS NOT DISTINCT FROM b.n_regionkey THEN 'skip' ELSE 'update' END AS action
    FROM a FULL JOIN b ON a.n_name = b.n_name) SELECT action, count(*) AS n FROM p GROUP BY 1""")
def sync_merge_counts(spark, d):
    return sync.plan(*_sides(spark, d), "n_name", ["n_regionkey"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SIDES} SELECT n_name FROM b WHERE n_name NOT IN (SELECT n_name FROM a)")
def sync_create(spark, d):
    old, new = _sides(spark, d)
    return sync.to_create(old, new, "n_name").select("n_name")


_VERSIONS = """a AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS occurrence FROM part WHERE p_partkey % 10 <> 0),
    b AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS occurrence FROM part WHERE p_partkey % 10 <> 1)"""


@query(f"""WITH {_VERSIONS} SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, CAST(coalesce(a.occurrence, b.occurrence) AS INT) AS occurrence,
    CASE WHEN a.p_brand IS NULL THEN 'added' WHEN b.p_brand IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.occurrence = b.occurrence
    WHERE a.p_size IS DISTINCT FROM b.p_size""")
def draft_diff(spark, d):
    part = t(spark, d, "part")
    return sync.difference(part.filter("p_partkey % 10 <> 0"), part.filter("p_partkey % 10 <> 1"), "p_brand", ["p_size"])


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS p, row_number() OVER (ORDER BY -n_regionkey * 100 - n_nationkey) AS q FROM nation) SELECT bool_or(p <> q) AS changed FROM o""")
def order_changed(spark, d):
    nation = t(spark, d, "nation")
    return sync.order_changed(nation.withColumn("p", F.col("n_nationkey")), nation.withColumn("p", -F.col("n_regionkey") * 100 - F.col("n_nationkey")), "n_name", "p")


@query("""WITH u AS (SELECT user_id, event_type, value, event_id FROM events WHERE event_id < 5000 UNION ALL SELECT user_id, event_type, value, event_id FROM events WHERE event_id >= 4000)
    SELECT user_id, event_type, value, event_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def upsert_last_wins(spark, d):
    events = t(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return sync.upserted(events.filter("event_id < 5000"), events.filter("event_id >= 4000"), ["user_id", "event_type"], "event_id")


@query("""SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def insert_first_wins(spark, d):
    events = t(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return sync.upserted(events.filter("event_id < 5000"), events.filter("event_id >= 4000"), ["user_id", "event_type"], "event_id", overwrite=False)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'New ' || s_name ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 0.5 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def partial_update(spark, d):
    table = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = table.filter("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("New "), "s_name").alias("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(0.5)).alias("s_acctbal"))
    return sync.patched(table, changes, "s_suppkey", ["s_name", "s_acctbal"])


_UNITS = """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE ' ' END AS abbreviation, s_suppkey % 5 = 0 AS on_hand, ['a' || s_nationkey, 'b'] AS aliases FROM supplier WHERE s_suppkey % 4 <> 0"""
_MORE = """SELECT s_suppkey, 'abbr' AS abbreviation, s_suppkey % 7 = 0 AS on_hand, ['b', 'c' || s_nationkey] AS aliases FROM supplier WHERE s_suppkey % 4 <> 1"""


@query(f"""WITH a AS ({_UNITS}), b AS ({_MORE}) SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN trim(coalesce(a.abbreviation, '')) <> '' THEN a.abbreviation ELSE b.abbreviation END AS abbreviation,
    coalesce(a.on_hand, false) OR coalesce(b.on_hand, false) AS on_hand,
    array_to_string(list_concat(coalesce(a.aliases, []), list_filter(coalesce(b.aliases, []), lambda x: NOT list_contains(coalesce(a.aliases, []), x))), ',') AS aliases
    FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey""")
def merge_taxonomy(spark, d):
    s = t(spark, d, "supplier")
    nation = F.col("s_nationkey").cast("string")
    a = s.filter("s_suppkey % 4 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lit(" ")).alias("abbreviation"), (F.col("s_suppkey") % 5 == 0).alias("on_hand"), F.array(F.concat(F.lit("a"), nation), F.lit("b")).alias("aliases"))
    b = s.filter("s_suppkey % 4 <> 1").select("s_suppkey", F.lit("abbr").alias("abbreviation"), (F.col("s_suppkey") % 7 == 0).alias("on_hand"), F.array(F.lit("b"), F.concat(F.lit("c"), nation)).alias("aliases"))
    return sync.merged(a, b, "s_suppkey", fill=["abbreviation"], either=["on_hand"], union=["aliases"]).withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 5")
def linked_once(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    first, more = lines.filter("l_linenumber <= 3").drop("l_linenumber"), lines.filter("l_linenumber BETWEEN 3 AND 5").drop("l_linenumber")
    return sync.linked_once(first, more)


@query("""SELECT n_nationkey, row_number() OVER (ORDER BY CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END NULLS LAST, n_name) AS new_position FROM nation""")
def positions(spark, d):
    nation = t(spark, d, "nation").withColumn("position", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")))
    return sync.positions(nation, "n_name", "position").select("n_nationkey", "new_position")


_SLUG = "regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || (p_partkey % 40)"


@query(f"""WITH r AS (SELECT p_partkey, {_SLUG} AS expected, CASE WHEN p_partkey % 4 = 0 THEN {_SLUG} ELSE 'old-' || p_partkey END AS slug FROM part),
    w AS (SELECT *, min(p_partkey) OVER (PARTITION BY expected) AS winner FROM r WHERE expected <> slug)
    SELECT p_partkey, slug AS old_slug, expected AS new_slug, CASE WHEN winner = p_partkey AND expected NOT IN (SELECT slug FROM r) THEN 'rename' ELSE 'conflict' END AS action FROM w""")
def slug_repair(spark, d):
    expected = F.concat_ws("-", plain_slug(F.col("p_name")), (F.col("p_partkey") % 40).cast("string"))
    part = t(spark, d, "part").withColumn("expected", expected).withColumn("slug", F.when(F.col("p_partkey") % 4 == 0, F.col("expected")).otherwise(F.concat(F.lit("old-"), F.col("p_partkey").cast("string"))))
    return sync.repaired_slugs(part, "p_partkey", "slug", "expected")


# Each part wants the name of the one before it, but some have theirs, some want a name that many want, and some one that comes later.
_WANTS = "CASE WHEN p_partkey % 1000 = 500 THEN 's' || (p_partkey + 1) WHEN p_partkey % 333 = 0 THEN 's' || p_partkey WHEN p_partkey % 17 = 3 THEN 'new' || (p_partkey % 5) WHEN p_partkey % 29 = 0 THEN 's' || (p_partkey - 2) ELSE 's' || (p_partkey - 1) END"
_TURNS = f"""WITH RECURSIVE r AS (SELECT p_partkey, 's' || p_partkey AS old, {_WANTS} AS new FROM part), w AS (SELECT * FROM r WHERE old <> new),
    a AS (SELECT w.p_partkey, w.new, h.p_partkey AS waits FROM w LEFT JOIN r ON r.old = w.new LEFT JOIN w AS h ON h.old = w.new WHERE r.old IS NULL OR h.p_partkey < w.p_partkey),
    f AS MATERIALIZED (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY new ORDER BY p_partkey) = 1),
    ok AS (SELECT p_partkey, waits FROM f WHERE waits IS NULL UNION ALL SELECT f.p_partkey, f.waits FROM ok JOIN f ON f.waits = ok.p_partkey),
    t AS (SELECT w.p_partkey, w.old AS old_name, w.new AS new_name, CASE WHEN ok.p_partkey IS NULL THEN 'conflict' ELSE 'rename' END AS action, ok.waits IS NOT NULL AS frees FROM w LEFT JOIN ok USING (p_partkey))"""


def _turns(spark, d):
    part = t(spark, d, "part").select("p_partkey", F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug"), F.expr(_WANTS).alias("wanted"))
    return renames.in_turn(part, "p_partkey", "p_partkey", "slug", "wanted")


@query(f"{_TURNS} SELECT * FROM t")
def renames_in_turn(spark, d):
    return _turns(spark, d)


@query(f"{_TURNS} SELECT count(*) FILTER (action = 'rename') AS applied, count(*) FILTER (action = 'conflict') AS skipped FROM t")
def rename_outcome(spark, d):
    return renames.rename_counts(_turns(spark, d))
