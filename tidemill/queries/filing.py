"""Filing by a model's replies, and lists to pick from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replies, search
from ..sources.scratch import scratch_path
from .registry import query, t


def stub(prompt: str) -> str | None:
    """A model that answers for most of the parts it is asked about, and fails on some batches."""
    slugs = [line.split(":")[0][2:] for line in prompt.split("\n")[1:]]
    if len(slugs) > 1 and int(slugs[0]) % 5 == 0:
        raise TimeoutError
    told = [f'{{slug: "{s}", "tags": ["METAL", "nowhere"], tools: "Brand#{int(s) % 25 + 1}; none",}}' for s in slugs if int(s) % 11]
    return "Here you are:\n```json\n[" + ", ".join(told) + "]\n```"


def tags_only(prompt: str) -> str:
    """A model that knows the same tags for everything."""
    return "[" + ", ".join(f'{{"slug": "{line.split(":")[0][2:]}", "tags": ["METAL", "nowhere"]}}' for line in prompt.split("\n")[1:]) + "]"


def _asked(spark, d):
    part = t(spark, d, "part").withColumn("slug", F.col("p_partkey").cast("string"))
    return part, replies.answered(part, "slug", "p_name", F.split("p_name", " "), stub, "File these:")


@query("SELECT CAST(p_partkey AS VARCHAR) AS slug, CASE WHEN p_partkey % 11 = 0 THEN 'missing' ELSE 'answered' END AS status FROM part")
def reply_outcomes(spark, d):
    part, found = _asked(spark, d)
    return replies.outcome(part, found)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS slug, 'Brand#' || (p_partkey % 25 + 1) AS tools FROM part WHERE p_partkey % 11 <> 0 AND 'Brand#' || (p_partkey % 25 + 1) IN (SELECT p_brand FROM part)""")
def reply_tools(spark, d):
    part, found = _asked(spark, d)
    out = replies.filed(part.withColumn("tools", F.lit(None).cast("array<string>")), found, part.select(F.col("p_brand").alias("name")), "tools")
    return out.withColumn("tools", F.array_join("tools", ","))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_size), 'ring brand#1')")
def search_rows(spark, d):
    return replies.searched(t(spark, d, "part"), ["p_name", "p_brand", "p_size"], " Ring BRAND#1 ").select("p_partkey", "p_name")


@query("SELECT DISTINCT p_name AS name, CASE p_name WHEN 'red bolt' THEN 1 WHEN 'hot rod' THEN 3 END AS rank FROM part")
def recommended_names(spark, d):
    return replies.recommended(t(spark, d, "part"), "p_name", ["red bolt", "no such", "hot rod"])


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN n_name ELSE CAST(s_nationkey AS VARCHAR) END AS shown FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def displayed_names(spark, d):
    return replies.displayed(t(spark, d, "supplier"), "s_nationkey", t(spark, d, "nation").filter("n_nationkey < 20"), "n_nationkey", "n_name").select("s_suppkey", "shown")


_ASKED = [("documents", "general public license"), ("documents", "E the"), ("pages", "</title>"), ("pages", "q"), ("pages", "no page says this")]


@query(" UNION ALL ".join(f"SELECT '{table}' AS source, '{text}' AS question, CAST({key} AS BIGINT) AS id FROM {table} WHERE contains(lower(concat_ws(' ', {columns})), lower('{text}'))" for table, text in _ASKED for key, columns in [("doc_id", "text") if table == "documents" else ("page_id", "url, html")]))
def search_indexed(spark, d):
    """Questions to the documents and pages, answered from an index of their trigrams."""
    out, at = None, {}
    for table, text in _ASKED:
        key, columns = ("doc_id", ["text"]) if table == "documents" else ("page_id", ["url", "html"])
        if table not in at:
            at[table] = scratch_path(spark, f"index-{table}")
            search.build(t(spark, d, table), key, columns, at[table])
        own = search.found(spark, at[table], text).select(F.lit(table).alias("source"), F.lit(text).alias("question"), F.col("key").cast("long").alias("id"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT 'manual' AS origin, event_id FROM events WHERE event_id % 4 IN (0, 1) AND contains(lower(event_type || ' ' || user_id), 'r 1') UNION ALL
    SELECT 'scheduled', event_id FROM events WHERE event_id % 4 IN (2, 3) AND contains(lower(event_type || ' ' || user_id), 'r 1')""")
def runs_shown(spark, d):
    """Runs by hand and scheduled ones in which a text stands."""
    k = F.col("event_id") % 4
    runs = replies.searched(t(spark, d, "events"), ["event_type", "user_id"], "R 1").withColumn("schedule", F.when(k == 1, "").when(k >= 2, F.concat(F.lit("s"), k.cast("string"))))
    own = [search.of_origin(runs, "schedule", o).select(F.lit(o).alias("origin"), "event_id") for o in ("manual", "scheduled")]
    return own[0].unionByName(own[1])
