"""Settings, options, schedules, progress and logs as a screen shows them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs, runs, views
from ..operators.audit import coverage, scored
from .registry import SCORED, checks, query, records, t


@query("""SELECT n_name AS key, 'L' || n_nationkey AS label, 'g' || n_regionkey AS "group", CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN '********' ELSE '' END WHEN n_nationkey % 2 = 0 THEN 'v' || n_nationkey WHEN n_nationkey % 5 = 0 THEN 'dflt' ELSE '' END AS value,
    CASE WHEN n_nationkey % 2 = 0 THEN 'env' WHEN n_nationkey % 5 = 0 THEN 'default' ELSE 'unset' END AS source, n_nationkey % 2 = 0 AS has_value FROM nation""")
def settings_shown(spark, d):
    k = F.col("n_nationkey")
    nation = t(spark, d, "nation")
    specs = nation.select(F.col("n_name").alias("key"), F.concat(F.lit("L"), k.cast("string")).alias("label"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("group"), (k % 3 == 0).alias("secret"), F.when(k % 5 == 0, "dflt").otherwise("").alias("default"))
    values = nation.filter("n_nationkey % 4 <> 3").select(F.col("n_name").alias("key"), F.when(k % 2 == 0, F.concat(F.lit("v"), k.cast("string"))).otherwise(" ").alias("value"), F.lit("env").alias("source"))
    return views.settings_view(specs, values)


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS allowed FROM nation")
def task_policies(spark, d):
    nation = t(spark, d, "nation")
    policies = nation.filter("n_nationkey % 2 = 0 OR n_nationkey % 3 = 0").select("n_nationkey", (F.col("n_nationkey") % 3 == 0).alias("allow"))
    return views.with_policy(nation, policies, "n_nationkey").select("n_nationkey", "allowed")


@query("""SELECT n_nationkey FROM nation WHERE CASE n_nationkey % 3 WHEN 0 THEN n_regionkey >= 2 WHEN 1 THEN NOT (n_regionkey >= 2 OR n_nationkey % 2 = 0) ELSE true END""")
def options_visible(spark, d):
    k = F.col("n_nationkey")
    cond = lambda a, b: F.struct(F.lit(a).alias("key"), F.lit(b).alias("value"))
    hidden = F.when(k % 3 == 0, F.array(cond("mode", "fast"))).when(k % 3 == 1, F.array(cond("mode", "slow"), cond("kind", "a")))
    chosen = F.create_map(F.lit("mode"), F.when(F.col("n_regionkey") < 2, "fast").otherwise("slow"), F.lit("kind"), F.when(k % 2 == 0, "a").otherwise("b"))
    return views.visible(t(spark, d, "nation").withColumns({"hidden": hidden, "chosen": chosen}), "hidden", "chosen").select("n_nationkey")


@query("""WITH f AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS v FROM conversations), c AS (SELECT conv_id, count(DISTINCT turn) AS n FROM f WHERE v <> '' GROUP BY 1) SELECT conv_id, n FROM c ORDER BY n DESC, conv_id LIMIT 1""")
def config_best(spark, d):
    found = t(spark, d, "conversations").withColumn("v", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")))
    return views.best_config(found, "conv_id", "turn", "v", "conv_id")


@query("""WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_regionkey < 2 GROUP BY 1), b AS (SELECT n_regionkey AS k, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, b.n, 0) AS n FROM a FULL JOIN b ON a.k = b.k""")
def live_totals(spark, d):
    nation = t(spark, d, "nation")
    live = nation.filter("n_regionkey < 2").groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    local = t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return views.totals(live, local, "k")


@query("""SELECT r_name AS "group", CASE r_name WHEN 'ASIA' THEN 1 WHEN 'AFRICA' THEN 2 ELSE 99 END AS place, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def option_groups(spark, d):
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "group")
    return views.grouped(rows, "group", ["ASIA", "AFRICA"], "n_name").withColumn("names", F.array_join("names", ","))


# --- schedules ----------------------------------------------------------------------

def _schedules(spark, d):
    events = t(spark, d, "events")
    now = F.lit(events.agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz")).first()[0])
    k = F.col("user_id")
    rows = events.groupBy("user_id").agg(F.date_trunc("second", F.min("ts")).cast("timestamp_ntz").alias("start"))
    rows = rows.withColumns({"every": F.when(k % 5 == 0, 0).when(k % 5 == 1, F.lit(None)).otherwise(3600 * (k % 24 + 1)), "until": F.when(k % 7 == 0, F.col("start") + F.expr("INTERVAL 3 DAYS"))})
    return rows, views.next_runs(rows, "user_id", "start", "every", "until", now).withColumn("next_run_at", F.col("next_run_at").cast("timestamp_ntz")), now


_NEXT = """now AS (SELECT date_trunc('second', max(ts)) AS now FROM events), s AS (SELECT user_id, date_trunc('second', min(ts)) AS start FROM events GROUP BY 1),
    e AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 5 > 1 THEN 3600 * (user_id % 24 + 1) END AS every, CASE WHEN user_id % 7 = 0 THEN start + INTERVAL 3 DAY END AS until FROM s, now),
    a AS (SELECT *, CASE WHEN every > 0 THEN start + (epoch(now - start)::BIGINT // every + 1) * every * INTERVAL 1 SECOND END AS due FROM e),
    n AS (SELECT user_id, CASE WHEN until IS NULL OR due <= until THEN due END AS next_run_at FROM a)"""


@query(f"WITH {_NEXT} SELECT * FROM n")
def schedules_next(spark, d):
    rows, jobs, _ = _schedules(spark, d)
    return views.with_next(rows.select("user_id"), jobs, "user_id")


@query(f"WITH {_NEXT} SELECT count(*) FILTER (next_run_at >= now AND next_run_at <= now + INTERVAL 24 HOUR) AS n FROM n, now")
def schedules_upcoming(spark, d):
    _, jobs, now = _schedules(spark, d)
    return views.upcoming(jobs, now)


@query(f"WITH {_NEXT} SELECT * FROM n WHERE next_run_at IS NOT NULL ORDER BY next_run_at, user_id LIMIT 3")
def schedules_soonest(spark, d):
    return views.soonest(_schedules(spark, d)[1], "user_id")


@query("""WITH now AS (SELECT date_trunc('second', max(ts)) AS now FROM events), f AS (SELECT user_id, date_trunc('hour', ts) AS fired FROM events GROUP BY 1, 2),
    m AS (SELECT user_id, max(fired) AS fired, true AS missed FROM f, now WHERE fired <= now - INTERVAL 2 DAY AND epoch_us(now) - epoch_us(fired) <= 604800000000 GROUP BY 1)
    SELECT user_id, fired, false AS missed FROM f, now WHERE fired > now - INTERVAL 2 DAY UNION ALL SELECT * FROM m""")
def missed_firings(spark, d):
    """After two days in which nothing ran, of the firings of the week before the last of each schedule runs."""
    events = t(spark, d, "events")
    now = F.lit(events.agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz")).first()[0])
    fired = events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("fired")).distinct()
    return views.coalesced(fired, "user_id", "fired", now - F.expr("INTERVAL 2 DAYS"), now, runs.grace(F.lit("interval"), F.lit(True)))


# --- progress -----------------------------------------------------------------------

@query("""WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS idx, count(*) OVER () AS total FROM nation) SELECT n_nationkey, idx, total, idx % greatest(1, total // 4) = 0 OR idx = total AS mark FROM n""")
def progress_marks(spark, d):
    return views.progress(t(spark, d, "nation"), ["n_name"]).select("n_nationkey", "idx", "total", "mark")


_PER = "p_size / (p_partkey % 7 + 1.0::DOUBLE)"


@query(f"""SELECT p_partkey, p_size || '/60 (' || printf('%.2f', CAST(round(CAST({_PER} AS DECIMAL(18, 9)), 2) AS DOUBLE)) || '/s) ETA: '
    || CASE WHEN p_size > 0 THEN printf('%.1f', CAST(round(CAST(greatest(60 - p_size, 0) / ({_PER}) / 60 AS DECIMAL(18, 9)), 1) AS DOUBLE)) ELSE 'inf' END || ' min' AS line FROM part""")
def rates(spark, d):
    return t(spark, d, "part").select("p_partkey", views.rate(F.col("p_size"), F.lit(60), F.col("p_partkey") % 7 + F.lit(1.0)).alias("line"))


@query("SELECT n_nationkey, least(30.0, 0.5 * pow(2.0, n_nationkey))::DOUBLE + 0.25::DOUBLE AS wait FROM nation")
def retry_waits(spark, d):
    return t(spark, d, "nation").select("n_nationkey", views.backoff(F.col("n_nationkey"), 0.5, 30, F.lit(0.5)).alias("wait"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def stamps(spark, d):
    return t(spark, d, "events").select("event_id", views.stamp(F.col("ts")).alias("stamp"), views.iso(F.col("ts")).alias("iso"))


@query("""WITH f AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'parsed' WHEN o_orderkey % 7 = 1 THEN 'needs_review' WHEN o_orderkey % 7 = 2 THEN 'empty' ELSE 'cached' END AS s FROM orders)
    SELECT count(*) AS total, count(*) FILTER (s = 'parsed') AS parsed, count(*) FILTER (s = 'needs_review') AS needs_review, count(*) FILTER (s = 'empty') AS empty, count(*) FILTER (s = 'cached') AS cached FROM f""")
def parser_summary(spark, d):
    k = F.col("o_orderkey") % 7
    rows = t(spark, d, "orders").withColumn("s", F.when(k == 0, "parsed").when(k == 1, "needs_review").when(k == 2, "empty").otherwise("cached"))
    return views.status_summary(rows, "s", ["parsed", "needs_review", "empty", "cached"])


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'Failed' ELSE upper(event_type[1]) || substr(event_type, 2) || ' run' END AS label FROM events")
def status_labels(spark, d):
    return t(spark, d, "events").select("event_id", views.label(F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.concat("event_type", F.lit("_run"))), {"error": "Failed"}).alias("label"))


@query(f"{SCORED} SELECT count(*) AS total, CAST(round_even(count(*) FILTER (c1) * 100.0::DOUBLE / count(*), 1) AS DOUBLE) AS category, CAST(round_even(count(*) FILTER (c2) * 100.0::DOUBLE / count(*), 1) AS DOUBLE) AS tags FROM scored")
def overview_coverage(spark, d):
    """All records, and how many percent of them have a category and tags."""
    rows = coverage(scored(records(spark, d), checks()), ["category", "tags"])
    return rows.groupBy("total").agg(*(F.max(F.when(F.col("dimension") == n, F.col("pct"))).alias(n) for n in ("category", "tags")))


# --- logs ---------------------------------------------------------------------------

_LOG = """CASE event_id % 16 WHEN 0 THEN '[start] data-maintenance stages=dedup,Names mode=dry ' WHEN 1 THEN '[start] dedup' WHEN 2 THEN '[ok] 3/9 item-' || user_id || ' duration=1.5s' WHEN 3 THEN '[done] dedup (1.0s)'
    WHEN 4 THEN '[start] names' WHEN 5 THEN '[error] names: exit code 2 (3s)' WHEN 6 THEN '[error] other' WHEN 7 THEN '[warning] slow' WHEN 8 THEN '[plan] slug-' || user_id || ': rename' WHEN 9 THEN '[done] 2 stage(s) run'
    WHEN 10 THEN '$ run it' WHEN 11 THEN '--------------------' WHEN 12 THEN '[ok] fine' WHEN 13 THEN '[summary] {}' WHEN 14 THEN '[dry-run] x' ELSE '[start] yield now' END"""
_EVENTS = f"""WITH l AS (SELECT user_id, event_id, {_LOG} AS line, event_id % 16 AS m FROM events), r AS (SELECT *, max(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS known FROM l),
    e AS (SELECT user_id, event_id, CASE m WHEN 0 THEN 'pipeline-start' WHEN 1 THEN CASE WHEN known THEN 'stage-start' ELSE 'start' END WHEN 2 THEN 'ok' WHEN 3 THEN CASE WHEN known THEN 'stage-done' ELSE 'done' END WHEN 4 THEN CASE WHEN known THEN 'stage-start' ELSE 'start' END
        WHEN 5 THEN CASE WHEN known THEN 'stage-error' ELSE 'error' END WHEN 6 THEN 'error' WHEN 7 THEN 'warning' WHEN 8 THEN 'plan' WHEN 9 THEN 'pipeline-done' WHEN 10 THEN 'command' WHEN 12 THEN 'verbose' WHEN 13 THEN 'summary' WHEN 14 THEN 'dryrun' ELSE 'start' END AS kind,
        CASE WHEN known AND m IN (1, 3) THEN 'dedup' WHEN known AND m IN (4, 5) THEN 'names' END AS stage, CASE m WHEN 2 THEN 'item-' || user_id WHEN 8 THEN 'slug-' || user_id END AS item, CASE WHEN m = 2 THEN 1.5::DOUBLE END AS seconds FROM r WHERE m <> 11)"""


def _events(spark, d):
    return logs.events(t(spark, d, "events").select("user_id", "event_id", F.expr(_LOG).alias("line")), "user_id", "event_id", "line")


@query(f"{_EVENTS} SELECT event_id, kind, stage, item, seconds FROM e")
def log_events(spark, d):
    return _events(spark, d).select("event_id", "kind", "stage", "item", "seconds")


@query(f"{_EVENTS} SELECT user_id, kind, count(*) AS n FROM e GROUP BY 1, 2")
def log_kinds(spark, d):
    return logs.kinds(_events(spark, d), "user_id")


@query(f"""{_EVENTS} SELECT user_id, stage, CASE arg_max(kind, event_id) WHEN 'stage-done' THEN 'succeeded' WHEN 'stage-error' THEN 'failed' ELSE 'unknown' END AS status, min(event_id) AS first
    FROM e WHERE kind IN ('stage-start', 'stage-done', 'stage-error') GROUP BY 1, 2""")
def log_stages(spark, d):
    return logs.stages(_events(spark, d), "user_id", "event_id")
