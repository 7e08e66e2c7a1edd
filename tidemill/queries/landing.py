"""Landed pages, logs, files and databases, and what is written back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, numbers
from ..operators import ingest, logs, runs, views
from ..operators.audit import scored
from ..plans import stages
from ..sources import paging, readers, writers
from ..sources.scratch import scratch_path
from ..sources.tailing import Tailed
from .registry import SCORED, query, records, t
from .registry import checks as quality_checks

_BASE = "https://h.example/api/items?page="


def _pages(spark, d):
    """The parts as a service's pages of fifty, which name the next page in three ways; each seventh names none."""
    part = t(spark, d, "part").withColumn("k", F.floor(F.col("p_partkey") / 50).cast("long"))
    rows = part.groupBy("k").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))))).alias("items"))
    to = F.concat((F.col("k") + 1).cast("string"), F.lit("&perPage=50&q=None"))
    link = F.when(F.col("k") % 7 == 6, "null").when(F.col("k") % 3 == 0, F.concat(F.lit('"/items?page='), to, F.lit('"'))).when(F.col("k") % 3 == 1, F.concat(F.lit(f'"{_BASE}'), to, F.lit('"'))).otherwise(F.concat(F.lit('"items?page='), to, F.lit('"')))
    body = F.concat(F.lit('{"items": '), F.regexp_replace("items", r"\]$", ', "no object"]'), F.lit(', "next": '), link, F.lit("}"))
    return rows.select(F.concat(F.lit(_BASE), F.col("k").cast("string"), F.when(F.col("k") > 0, "&perPage=50").otherwise("")).alias("url"), body.alias("body"))


_KEYS = f"k AS (SELECT DISTINCT p_partkey // 50 AS k FROM part), u AS (SELECT k, '{_BASE}' || k || CASE WHEN k > 0 THEN '&perPage=50' ELSE '' END AS url FROM k)"


@query(f"WITH {_KEYS} SELECT url, count(*) AS n, count(DISTINCT p_name) AS names FROM u JOIN part ON p_partkey // 50 = k GROUP BY 1")
def landed_rows(spark, d):
    rows = paging.page_rows(_pages(spark, d), "url", "body", "id string, name string")
    return rows.groupBy("url").agg(F.count("id").alias("n"), F.count_distinct("name").alias("names"))


@query(f"WITH {_KEYS} SELECT url, CASE WHEN k % 7 <> 6 THEN '{_BASE}' || (k + 1) || '&perPage=50' END AS next FROM u")
def landed_next(spark, d):
    return _pages(spark, d).select("url", paging.linked_to(F.col("url"), F.get_json_object("body", "$.next")).alias("next"))


@query(f"WITH {_KEYS} SELECT url FROM u WHERE k <= 6")
def pages_reached(spark, d):
    """The pages that a reader comes to from the first, up to the one that names no other."""
    return paging.reached(_pages(spark, d), "url", "body", [f"{_BASE}0"])


_LOG = "'[ok] ' || event_id || ' ' || event_type || ' ' || user_id"


@query(f"""WITH l AS (SELECT user_id, string_agg({_LOG}, chr(10) ORDER BY event_id) AS log FROM events GROUP BY 1)
    SELECT user_id, length(log) AS size, right(log, 120) AS tail, substr(log, 51, 100) AS part FROM l""")
def log_chunks(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", F.expr(_LOG).alias("line"))
    log = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("l")).select("user_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("log"))
    return log.select("user_id", F.octet_length("log").cast("long").alias("size"), logs.last_bytes(F.col("log"), 120).alias("tail"), logs.chunk(F.col("log"), 50, 100).alias("part"))


@query(f"{SCORED} SELECT true AS available, count(*) AS total, count(*) FILTER (score >= 5) AS gold, count(*) FILTER (score IN (3, 4)) AS silver, count(*) FILTER (score < 3) AS bronze FROM scored")
def report_read(spark, d):
    """The audit's summary, written as a report and read again."""
    found = views.status_summary(scored(records(spark, d), quality_checks()), "tier", ["gold", "silver", "bronze"])
    at = scratch_path(spark, "report")
    writers.report(found, at)
    return readers.report_summary(spark, at, ["total", "gold", "silver", "bronze"])


@query("""SELECT n_name AS name, 'n_nationkey=' || n_nationkey AS path, n_nationkey % 3 <> 0 AS "exists", 'table' AS expected_type FROM nation""")
def managed_files(spark, d):
    """A folder for each nation, of which a third were never written."""
    at, nation = scratch_path(spark, "managed"), t(spark, d, "nation").orderBy("n_nationkey")
    nation.filter("n_nationkey % 3 <> 0").write.partitionBy("n_nationkey").parquet(at)
    return readers.managed_files(spark, at, [(r["n_name"], f"n_nationkey={r['n_nationkey']}", "table") for r in nation.collect()])  # a few names


@query("SELECT p_name || ' ' || p_size AS value FROM part")
def success_log(spark, d):
    at = scratch_path(spark, "successes")
    writers.success_log(t(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("line")), "line", at)
    return spark.read.text(at)


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1")
def checkpoint_written(spark, d):
    """Keys are added to a checkpoint twice; what it doesn't list is left."""
    part, at = t(spark, d, "part"), scratch_path(spark, "checkpoint")
    writers.checkpointed(part.filter("p_partkey % 3 = 0"), "p_partkey", at)
    writers.checkpointed(part.filter("p_partkey % 4 = 1"), "p_partkey", at)
    return ingest.unprocessed(part, spark.read.parquet(at), "p_partkey").select("p_partkey")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 10 THEN p_size * 1.0::DOUBLE END AS servings FROM part")
def catalog_rows(spark, d):
    """Records landed as JSON pages, and read as a table."""
    part, at = t(spark, d, "part"), scratch_path(spark, "catalog")
    row = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("recipeServings"))
    part.groupBy(F.pmod(F.xxhash64("p_partkey"), F.lit(8)).alias("k")).agg(F.to_json(F.struct(F.collect_list(row).alias("items"))).alias("value")).select("value").write.text(at)
    return readers.catalog(spark, at, whole=False).select(F.col("id").cast("long").alias("id"), "name", F.col("recipeServings").alias("servings"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def json_rows(spark, d):
    """A table of JSON rows; one that isn't there is empty."""
    at = scratch_path(spark, "rows")
    t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.json(at)
    none = readers.json_table(spark, f"{at}-none", "id long, name string")
    return spark.read.schema("id long, name string").json(at).unionByName(none)


_ENV = """CASE turn % 4 WHEN 0 THEN '  - POSTGRES_USER=u' || conv_id WHEN 1 THEN 'export POSTGRES_PORT="' || turn || '"' WHEN 2 THEN 'POSTGRES_DB: db' || turn || ' # note' ELSE CASE WHEN conv_id % 9 = 0 THEN 'POSTGRES_URL_OVERRIDE=x:' || conv_id ELSE '# POSTGRES_DB=no' END END"""


@query(f"""WITH l AS (SELECT conv_id, turn, turn % 4 AS m FROM conversations), s AS (
        SELECT conv_id, CASE m WHEN 0 THEN 'user' WHEN 1 THEN 'port' WHEN 2 THEN 'name' ELSE 'url' END AS key,
            arg_max(CASE m WHEN 0 THEN 'u' || conv_id WHEN 1 THEN CAST(turn AS VARCHAR) WHEN 2 THEN 'db' || turn ELSE 'x:' || conv_id END, turn) AS value
        FROM l WHERE m < 3 OR conv_id % 9 = 0 GROUP BY 1, 2)
    SELECT * FROM s WHERE key = 'url' OR conv_id NOT IN (SELECT conv_id FROM s WHERE key = 'url')""")
def service_settings(spark, d):
    lines = t(spark, d, "conversations").select("conv_id", "turn", F.expr(_ENV.replace('\\"', '"')).alias("value"))
    names = {"POSTGRES_USER": "user", "POSTGRES_PORT": "port", "POSTGRES_DB": "name", "POSTGRES_URL_OVERRIDE": "url"}
    return readers.service_settings(lines, ["conv_id"], "value", "turn", names, "url")


@query("SELECT event_id, user_id FROM events WHERE event_id % 5 <> 0 AND ts <= (SELECT max(ts) - INTERVAL 7 DAY FROM events) OR event_id % 5 = 0")
def expired_rows(spark, d):
    """Rows past their time, and those whose time can't be read."""
    events = t(spark, d, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    until = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return writers.expired(events, until, now).select("event_id", "user_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) > 5")
def rotated_files(spark, d):
    return writers.to_rotate(t(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return t(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'r' || n_regionkey ELSE '' END AS shown FROM nation")
def names_given(spark, d):
    from ..functions.text import first_given

    k = F.col("n_nationkey") % 3
    return t(spark, d, "nation").select("n_nationkey", first_given(F.when(k == 0, F.concat("n_name", F.lit(" "))), F.when(k == 1, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).otherwise("  ")).alias("shown"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_name || '|' || p_type WHEN 2 THEN p_brand ELSE '' END AS lines FROM part")
def raw_ingredients(spark, d):
    """Texts of ingredients that aren't parsed yet; null where one has a food."""
    k = F.col("p_partkey") % 4
    item = lambda food, original, raw, note, display: F.struct(food.cast("string").alias("food"), original.cast("string").alias("original_text"), raw.cast("string").alias("raw_text"), note.cast("string").alias("note"), display.cast("string").alias("display"))
    none = F.lit(None)
    items = F.array(
        item(F.when(k == 0, "x"), F.when(k == 1, F.concat(F.lit(" "), "p_name")), none, none, none),
        item(none, F.lit(" "), none, F.when(k == 1, F.col("p_type")), F.when(k == 2, F.col("p_brand"))),
    )
    return t(spark, d, "part").select("p_partkey", F.array_join(ingest.raw_lines(items), "|").alias("lines"))


@query("""SELECT user_id, max(ts) AS ts FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY ts DESC, user_id LIMIT 10""")
def recent_started(spark, d):
    """Runs by the time they started, or were made if they haven't."""
    e = t(spark, d, "events").filter("event_type <> 'view'").withColumns({"started": F.when(F.col("event_id") % 2 == 0, F.col("ts")), "created": F.col("ts")})
    return e.groupBy("user_id").agg(F.max(F.coalesce("started", "created")).alias("ts")).orderBy(F.desc("ts"), "user_id").limit(10)


@query("""SELECT user_id, arg_max(event_type, event_id) AS status, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1""")
def run_states(spark, d):
    from ..streaming.limits import run_states as states

    return states(t(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT event_id, epoch_us(ts) % 1000000 / 1000000.0::DOUBLE AS x, date_diff('microsecond', ts, coalesce(CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 90 SECOND END, (SELECT max(ts) FROM events))) / 1000000.0::DOUBLE AS seconds FROM events")
def run_seconds(spark, d):
    events = t(spark, d, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    finished = F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 90 SECONDS"))
    return events.select("event_id", (runs.micros("ts") % 1_000_000 / 1_000_000).alias("x"), views.ran_for(F.col("ts"), finished, now).alias("seconds"))


@query("""SELECT 0 AS seq, 'junk' AS stage, 'ok' AS status, count(*) FILTER (p_size < 10) AS planned FROM part UNION ALL SELECT 1, 'names', 'failed', 0
    UNION ALL SELECT 2, 'yield', 'ok', count(*) FROM lineitem WHERE l_quantity < 20""")
def maintenance_run(spark, d):
    """Three stages over the parts and lines, of which one fails."""
    def broken(tables):
        raise ValueError("no names")
    todo = {"junk": lambda tables: (tables["part"].filter("p_size < 10"), {}), "names": broken, "yield": lambda tables: (tables["lineitem"].filter("l_quantity < 20"), {})}
    done = stages.run(todo, {n: t(spark, d, n) for n in ("part", "lineitem")}, stages.stage_list("junk, names,yield,junk"))
    return done.summary(spark).select("seq", "stage", "status", "planned")


_TEXT = """CASE p_partkey % 4 WHEN 0 THEN '"mix ' || p_name || '"' WHEN 1 THEN '["cut ' || p_name || '", "serve"]' WHEN 2 THEN '[{"text": "fry ' || p_name || '"}, {"name": "rest"}, {"text": "", "name": "eat"}]' ELSE 'plain ' || p_name END"""


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '"mix ' || p_name || '"' WHEN 1 THEN 'cut ' || p_name || ' serve' WHEN 2 THEN 'fry ' || p_name || ' rest eat' ELSE 'plain ' || p_name END AS text FROM part""")
def instruction_texts(spark, d):
    return t(spark, d, "part").select("p_partkey", checks.instructions(F.expr(_TEXT)).alias("text"))


@query("SELECT o_orderkey, 'p' || (o_orderkey % 10) AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'none' END AS b FROM orders")
def config_paths(spark, d):
    config = F.concat(F.lit('{"parser": {"name.x": 1, "deep": {"name": "p'), (F.col("o_orderkey") % 10).cast("string"), F.lit('"'), F.when(F.col("o_orderkey") % 2 == 0, F.lit(', "b": "x"')).otherwise(""), F.lit("}}}"))
    return t(spark, d, "orders").select("o_orderkey", checks.at_path(config, "parser.deep.name").alias("a"), checks.at_path(config, "parser.deep.b", "none").alias("b"))


@query("SELECT p_partkey, left(sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\"}'), 16) AS version FROM part")
def stable_versions(spark, d):
    """Versions of JSON whatever the order of its keys."""
    a, b = F.concat(F.lit('"name": "'), "p_name", F.lit('"')), F.concat(F.lit('"brand":"'), "p_brand", F.lit('"'))
    text = F.concat(F.lit("{"), F.when(F.col("p_partkey") % 2 == 0, F.concat(a, F.lit(", "), b)).otherwise(F.concat(b, F.lit(","), a)), F.lit("}"))
    return t(spark, d, "part").select("p_partkey", numbers.version(checks.stable_json(text, ["name", "brand"])).alias("version"))


@query("SELECT o_orderkey, o_orderkey % 3 = 1 AS \"any\" FROM orders")
def nutrition_any(spark, d):
    k = F.col("o_orderkey") % 3
    facts = F.create_map(F.lit("calories"), F.when(k == 0, "0").when(k == 1, "250").otherwise(""), F.lit("fat"), F.lit(None).cast("string"))
    return t(spark, d, "orders").select("o_orderkey", checks.any_truthy(facts).alias("any"))


_FORM = """p_partkey, p_name AS u, CASE WHEN p_partkey % 3 = 0 THEN 'Secret1' || p_name WHEN p_partkey % 3 = 1 THEN 'secret1' || p_name ELSE 'Se1' END AS w, CASE WHEN p_partkey % 2 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE p_name END AS e,
    replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '_' END) AS h, CASE WHEN p_partkey % 5 = 0 THEN 'https://169.254.169.254/x' WHEN p_partkey % 5 = 1 THEN 'ftp://a.b' ELSE 'http://' || replace(p_name, ' ', '.') || ':80/x' END AS s"""
_FORMS = f"SELECT {_FORM} FROM part"


@query(rf"""WITH f AS ({_FORMS}) SELECT p_partkey, regexp_full_match(replace(u, ' ', CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE ' ' END), '[a-zA-Z0-9_.-]{{3,64}}') AS username,
    length(w) >= 8 AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[0-9]') AS password, regexp_full_match(e, '[A-Z0-9_]+') AS env_key,
    regexp_full_match(h, '[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)*') AS host, regexp_full_match(h, '[a-z_][a-z0-9_.-]{{0,31}}') AS account,
    regexp_full_match(h, '[a-zA-Z0-9][a-zA-Z0-9_.-]*') AS container, p_partkey % 5 > 1 AS service FROM f""")
def formats_valid(spark, d):
    f = spark.sql("SELECT " + _FORM + " FROM {part}", part=t(spark, d, "part"))
    return f.select(
        "p_partkey", checks.username(F.replace("u", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, ".").otherwise(" "))).alias("username"), checks.password(F.col("w")).alias("password"), checks.env_key(F.col("e")).alias("env_key"),
        checks.host(F.col("h")).alias("host"), checks.account(F.col("h")).alias("account"), checks.container(F.col("h")).alias("container"), checks.service_url(F.col("s")).alias("service"),
    )


@query(r"""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(coalesce(text, ''), '\r', '', 'g'), chr(10))) AS line FROM documents) GROUP BY 1""")
def tailed_lines(spark, d):
    """The documents' lines, landed as log files and read again by byte ranges that cut lines."""
    path = scratch_path(spark, "tailed")
    t(spark, d, "documents").select(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", "").alias("value")).write.text(path)
    spark.dataSource.register(Tailed)
    lines = spark.read.format("tailed").option("path", path).option("rangeBytes", 4 << 20).load()
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


_ROUTED = "SELECT o_orderkey, o_orderkey % 50 AS service, CASE o_orderkey % 3 WHEN 0 THEN '/organizers/tools' WHEN 1 THEN '/tools' ELSE '/other' END AS route, CASE WHEN o_orderkey % 50 IN (3, 7) AND o_orderkey % 3 = 0 THEN 404 WHEN o_orderkey % 50 = 7 THEN 404 ELSE 200 END AS status FROM orders"


@query(f"""WITH p AS ({_ROUTED}), a AS (SELECT service, route, max(CAST(status = 404 AS INT)) = 1 AS gone FROM p WHERE route <> '/other' GROUP BY 1, 2),
    f AS (SELECT service, min(route) AS route FROM a WHERE NOT gone GROUP BY 1) SELECT o_orderkey, service, route FROM p SEMI JOIN f USING (service, route)""")
def pages_answered(spark, d):
    """The pages of each service's route for tools, or of its older one where that is missing."""
    pages = spark.sql(_ROUTED.replace("FROM orders", "FROM {orders}"), orders=t(spark, d, "orders"))
    return paging.answered(pages, "service", "route", "status", ["/organizers/tools", "/tools"]).select("o_orderkey", F.col("service").cast("long").alias("service"), "route")
