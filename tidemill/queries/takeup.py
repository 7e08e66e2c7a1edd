"""Which records to take up, their lines, and pages that are no records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from .registry import query, t

_NAMES = [
    (-1, "How to make bread", "bread", ""), (-2, "Top 10 meals of the year", "top", ""), (-3, "12 easy dishes", "x", ""), (-4, "News", "weekly-round-up", ""), (-5, "Kitchen tools we love", "k", ""),
    (-6, "Soup", "privacy-policy", ""), (-7, "Stew", "stew", "Sorry: no instructions found here"), (-8, "Pie", "pie", "bake it"), (-9, "Best ever desserts", "d", ""), (-10, "Restored chair", "restored", ""),
]
_LIKE = lambda c, words: " OR ".join(f"contains({c}, '{w}')" for w in words)
_JUNK = rf"""WITH p AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS n, lower(source) AS s, '' AS i FROM documents
        UNION ALL SELECT * FROM (VALUES {', '.join(f"({a}, '{b.lower()}', '{c.lower()}', '{e.lower()}')" for a, b, c, e in _NAMES)}) v(id, n, s, i)),
    c AS (SELECT id, CASE WHEN regexp_matches(n, '{ingest.HOW_TO}') THEN 'how_to' WHEN regexp_matches(n, '{ingest.LISTICLE}') THEN 'listicle'
        WHEN regexp_matches(n, '{ingest.DIGEST}') OR regexp_matches(replace(s, '-', ' '), '{ingest.DIGEST}') THEN 'digest'
        WHEN {_LIKE('n', ingest.JUNK_KEYWORDS)} THEN 'keyword' WHEN {_LIKE('s', ingest.UTILITY_SLUGS)} THEN 'utility' WHEN {_LIKE('i', ingest.BAD_INSTRUCTIONS)} THEN 'bad_instructions' END AS reason FROM p)"""


def _junk(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.col("source").alias("slug"), F.lit("").alias("instructions"))
    pages = docs.unionByName(spark.createDataFrame(_NAMES, "id long, name string, slug string, instructions string"))
    return pages.select("id", ingest.junk_class(F.col("name"), F.col("slug"), F.col("instructions")).alias("reason"))


@query(f"{_JUNK} SELECT id, reason FROM c WHERE reason IS NOT NULL")
def junk_classify(spark, d):
    return _junk(spark, d).filter("reason IS NOT NULL")


@query(f"{_JUNK} SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 1")
def junk_by_reason(spark, d):
    return _junk(spark, d).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_CACHE = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'older' END AS updated_at, CASE o_orderkey % 5 WHEN 0 THEN 'parsed' WHEN 1 THEN 'needs_review' WHEN 2 THEN '' ELSE 'failed' END AS status FROM orders WHERE o_orderkey % 3 <> 0"


@query(f"""WITH c AS ({_CACHE}), r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS updated, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag FROM orders)
    SELECT r.o_orderkey, CASE WHEN flag THEN 'done' WHEN NOT flag THEN 'take' WHEN c.updated_at = updated AND c.status IN ('already_parsed', 'empty', 'parsed', 'needs_review') THEN 'cached' ELSE 'take' END AS decision
    FROM r LEFT JOIN c ON c.o_orderkey = r.o_orderkey AND c.status <> ''""")
def candidate_filter(spark, d):
    orders = t(spark, d, "orders")
    updated = F.date_format("o_orderdate", "yyyy-MM-dd")
    cache = orders.filter("o_orderkey % 3 <> 0").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, updated).otherwise(F.lit("older")).alias("updated_at"),
        F.element_at(F.array(*map(F.lit, ["parsed", "needs_review", "", "failed", "failed"])), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"),
    )
    flag = F.when(F.col("o_orderstatus") == "F", F.lit(True)).when(F.col("o_orderstatus") == "O", F.lit(False))
    return ingest.candidates(orders, cache, "o_orderkey", flag, updated).select("o_orderkey", "decision")


@query("SELECT p_partkey, p_name FROM part WHERE p_name > 'hot gear' ")
def cursor_resume(spark, d):
    return ingest.after_cursor(t(spark, d, "part"), "p_name", "hot gear").select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part")
def cursor_unknown(spark, d):
    return ingest.after_cursor(t(spark, d, "part"), "p_name", "no such name").select("p_partkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def checkpoint_skip(spark, d):
    return ingest.unprocessed(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id").select("doc_id")


_LINES = r"""WITH l AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), ['For the sauce', 'Filling:', '  2  cups   of it', 'to serve 4', ''])) AS x FROM documents),
    c AS (SELECT doc_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x FROM l),
    h AS (SELECT *, x = '' OR (len(string_split(x, ' ')) <= 8 AND NOT regexp_matches(x, '\d') AND (x LIKE '%:' OR regexp_matches(lower(x), '^(for|to)\s'))) AS header FROM c)"""


@query(f"{_LINES} SELECT doc_id, count(*) FILTER (NOT header) AS kept, count(*) FILTER (header) AS dropped FROM h GROUP BY 1")
def ingredient_lines(spark, d):
    docs = t(spark, d, "documents")
    lines = F.concat(F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")), F.array(*map(F.lit, ["For the sauce", "Filling:", "  2  cups   of it", "to serve 4", ""])))
    kept = F.size(ingest.clean_lines(lines))
    return docs.select("doc_id", kept.cast("long").alias("kept"), (F.size(lines) - kept).cast("long").alias("dropped"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'for serving' WHEN 2 THEN 'salt to taste' WHEN 3 THEN '' ELSE l_returnflag END AS note, CASE WHEN l_quantity < 20 THEN 0.0 ELSE l_quantity END AS quantity,
        CASE WHEN l_partkey % 3 <> 0 THEN 'food' END AS food, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_suppkey % 10 = 0 THEN 'Pinch' ELSE 'cup' END END AS unit FROM lineitem),
    s AS (SELECT *, CASE WHEN note = '' AND quantity = 0 AND food IS NULL AND unit IS NULL THEN NULL WHEN note = 'for serving' THEN NULL
        WHEN quantity = 0 AND unit IS NOT NULL THEN CASE WHEN note LIKE '%to taste%' OR lower(unit) IN ('pinch', 'dash') THEN NULL ELSE 'zero_qty_with_unit' END WHEN food IS NULL AND note = '' THEN 'missing_food_no_note' END AS reason FROM i)
    SELECT reason, l_linenumber, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY 1, 2""")
def suspicious_lines(spark, d):
    number, supplier = F.col("l_linenumber"), F.col("l_suppkey")
    note = F.when(number == 1, "for serving").when(number == 2, "salt to taste").when(number == 3, "").otherwise(F.col("l_returnflag"))
    amount = F.when(F.col("l_quantity") < 20, 0.0).otherwise(F.col("l_quantity"))
    unit = F.when(supplier % 2 == 0, F.when(supplier % 10 == 0, "Pinch").otherwise("cup"))
    reason = ingest.suspicion(note, amount, F.when(F.col("l_partkey") % 3 != 0, "food"), unit)
    return t(spark, d, "lineitem").select(number, reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT l_orderkey, l_returnflag AS strategy, min(1 - l_discount) >= 0.95 AS ok FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, arg_min(strategy, CASE strategy WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS strategy FROM a WHERE ok GROUP BY 1""")
def first_accepted(spark, d):
    attempts = t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("strategy")).agg(F.collect_list(1 - F.col("l_discount")).alias("confidences"))
    return ingest.first_accepted(attempts, "l_orderkey", ["R", "A", "N"], 0.95)


@query("""SELECT o_orderkey, array_to_string(CASE o_orderkey % 3 WHEN 0 THEN ['x', 'y', 'z'] WHEN 1 THEN ['y', 'x', 'z'] ELSE ['z', 'x'] END, ',') AS tags FROM orders""")
def tags_appended(spark, d):
    have = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("y")))
    new = F.when(F.col("o_orderkey") % 3 == 2, F.array(F.lit("z"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("z"), F.lit("x")))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(ingest.appended(have, new), ",").alias("tags"))
