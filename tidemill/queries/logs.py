"""Runs, schedules, logs and limits; events stand for runs, and their newest time for now."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources.readers import blocks, env_lines, tail
from ..sources.scratch import scratch_path, written
from ..streaming import limits
from ..streaming.schedules import fired
from ..streaming.taken import Taken
from .registry import SQL, query, t

_TYPES = ["click", "error", "purchase", "signup", "view"]


def _now(events):
    return F.lit(events.agg(F.max("ts")).first()[0])


@query(f"SELECT user_id, count(*) AS total, {', '.join(f'''count(*) FILTER (event_type = '{x}') AS {x}''' for x in _TYPES)} FROM events GROUP BY 1")
def run_status_counts(spark, d):
    return R.status_counts(t(spark, d, "events"), "user_id", "event_type", _TYPES)


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
    SELECT event_type, n, CAST(floor(n * 100.0::DOUBLE / sum(n) OVER () + 0.5) AS BIGINT) AS pct FROM n""")
def task_mix_7d(spark, d):
    events = t(spark, d, "events")
    return R.mix(events, "event_type", "ts", _now(events))


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, CAST(floor(date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) / 86400000000) AS BIGINT) AS age_days
    FROM events WHERE event_type = 'error' GROUP BY 1""")
def latest_failure(spark, d):
    events = t(spark, d, "events")
    last = R.latest(events.filter("event_type = 'error'"), "user_id", "ts", ["event_id"])
    return last.withColumn("age_days", R.age_days(F.col("ts"), _now(events)))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def runs_per_day(spark, d):
    return t(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def recent_runs(spark, d):
    return t(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "ts")


@query("""SELECT event_id, user_id, count(*) OVER w AS n, count(*) OVER w > 1 AS blocked FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)""")
def action_limiter(spark, d):
    return R.over_limit(t(spark, d, "events"), "user_id", "ts", 300, 1).select("event_id", "user_id", "n", "blocked")


@query("""WITH e AS (SELECT *, coalesce(sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch
        FROM events WHERE event_type IN ('error', 'signup')),
    r AS (SELECT event_id, user_id, CAST(coalesce(sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id, epoch ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS recent FROM e)
    SELECT event_id, user_id, recent, recent >= 3 AS blocked FROM r""")
def login_limiter(spark, d):
    attempts = t(spark, d, "events").filter("event_type IN ('error', 'signup')").withColumn("attempt", F.col("event_id"))
    return R.blocked_logins(attempts, "user_id", "ts", F.col("event_type") == "error", 86400, 3).select("event_id", "user_id", "recent", "blocked")


@query("""WITH s AS (SELECT user_id, date_trunc('second', min(ts)) AS start, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 3600 * (user_id % 24 + 1) END AS every FROM events GROUP BY 1)
    SELECT user_id, start + k * every * INTERVAL 1 SECOND AS fires_at FROM s, unnest(range(0, 8760)) t(k) WHERE every > 0 AND start + k * every * INTERVAL 1 SECOND <= (SELECT date_trunc('second', max(ts)) FROM events)""")
def interval_firings(spark, d):
    events = t(spark, d, "events")
    schedules = events.groupBy("user_id").agg(F.date_trunc("second", F.min("ts")).alias("start")).withColumn("every", F.when(F.col("user_id") % 5 == 0, 0).otherwise(3600 * (F.col("user_id") % 24 + 1)))
    return R.firings(schedules, "user_id", "start", "every", F.date_trunc("second", _now(events)))


@query("""SELECT event_id, CASE WHEN coalesce(value, 0) < 10 THEN 60 WHEN event_type = 'signup' THEN 2592000 ELSE 604800 END AS grace FROM events""")
def misfire_grace(spark, d):
    kind = F.when(F.col("event_type") == "signup", "once").otherwise("interval")
    return t(spark, d, "events").select("event_id", R.grace(kind, F.col("value") >= 10).alias("grace"))


@query("SELECT event_type, CAST(props ->> '$.k' AS BIGINT) % 10 AS k, count(*) AS n, sum(CAST(props ->> '$.k' AS BIGINT)) AS total FROM events GROUP BY 1, 2")
def run_option_json(spark, d):
    k = F.get_json_object(F.coalesce(F.nullif("props", F.lit("")), F.lit("{}")), "$.k").try_cast("long")
    return t(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type", (F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


_LOG = """CASE event_type WHEN 'error' THEN '[error] ' || (event_id % 40) || '/40 item-' || user_id || ' failed' WHEN 'view' THEN '[ok] ' || (event_id % 40) || '/40 item-' || user_id || ' duration=' || (event_id % 7) || '.5s'
    WHEN 'click' THEN '[warn] slow' WHEN 'signup' THEN '[start] stage' ELSE 'plain text' END"""


def _lines(spark, d):
    return t(spark, d, "events").withColumn("line", F.expr(_LOG))


@query(f"""WITH l AS (SELECT user_id, {_LOG} AS line FROM events), e AS (SELECT user_id, nullif(lower(regexp_extract(line, '^\\s*\\[([A-Za-z_-]+)\\]', 1)), '') AS kind,
        TRY_CAST(nullif(regexp_extract(line, '(?:^|\\s)(\\d+)/(\\d+)(?:\\s+(\\S+))?', 1), '') AS BIGINT) AS done, TRY_CAST(nullif(regexp_extract(line, '(?:^|\\s)(\\d+)/(\\d+)(?:\\s+(\\S+))?', 2), '') AS BIGINT) AS total FROM l)
    SELECT user_id, count(*) AS lines, count(*) FILTER (kind = 'ok') AS ok, count(*) FILTER (kind = 'warn') AS warnings, count(*) FILTER (kind = 'error') AS errors, max(total) AS most, max(done) AS done,
        round_even(coalesce(max(done), 0) * 100.0::DOUBLE / greatest(coalesce(max(total), 0), 1), 0) AS pct FROM e GROUP BY 1""")
def log_event_counts(spark, d):
    return R.log_summary(R.log_events(_lines(spark, d), "line"), "user_id")


@query(f"""WITH l AS (SELECT *, {_LOG} AS line FROM events), s AS (SELECT user_id, event_id, sum(CAST(line LIKE '[start]%' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM l)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first FROM s GROUP BY 1, 2""")
def stage_sessions(spark, d):
    marked = R.sessions(_lines(spark, d), "user_id", "event_id", F.col("line").startswith("[start]"))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("""WITH g AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
    i AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY user_id, event_type, k)
    SELECT user_id, event_type, n, first, last, row_number() OVER (PARTITION BY user_id ORDER BY first) AS island FROM i""")
def gaps_islands(spark, d):
    return R.islands(t(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS BIGINT) AS batch FROM conversations")
def batches(spark, d):
    return R.batches(t(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "batch")


@query("SELECT conv_id, string_agg(left(role, 1) || length(text), ' ' ORDER BY turn) AS said, count(*) AS turns FROM conversations GROUP BY 1")
def chunks_joined(spark, d):
    """Pieces of a stream put together in their order."""
    pieces = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.left("role", F.lit(1)), F.length("text").cast("string")).alias("x")))).alias("p"), F.count(F.lit(1)).alias("turns"))
    return pieces.select("conv_id", F.array_join(F.transform("p", lambda x: x["x"]), " ").alias("said"), "turns")


@query("""WITH r AS (SELECT user_id AS key, CAST(value AS VARCHAR) AS value, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'click', 'error')) WHERE k = 1 AND user_id % 4 <> rank)
    SELECT key, CASE rank WHEN 0 THEN 'default' WHEN 1 THEN 'env' ELSE 'setting' END AS source FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC) = 1""")
def settings_precedence(spark, d):
    events = t(spark, d, "events")
    layers = []
    for rank, (name, kind) in enumerate((("default", "view"), ("env", "click"), ("setting", "error"))):
        own = events.filter((F.col("event_type") == kind) & (F.col("user_id") % 4 != rank)).groupBy("user_id").agg(F.min_by(F.col("value").cast("string"), "event_id").alias("value"))
        layers.append((name, own.select(F.col("user_id").alias("key"), "value")))
    return R.settings(*layers).select("key", "source")


@query("SELECT event_id, line FROM (SELECT event_id, " + _LOG + " AS line FROM events) WHERE line <> '[warn] slow' ORDER BY event_id DESC LIMIT 50")
def log_tail(spark, d):
    return tail(_lines(spark, d).select("event_id", "line"), "event_id", 50, F.col("line") == "[warn] slow")


_FILES = "CASE WHEN turn = 0 THEN '__CFG_FILE__:/etc/' || conv_id || '.env' WHEN turn % 3 = 0 THEN '# note' WHEN turn % 3 = 1 THEN 'export K' || turn || '=\"' || role || '\"' ELSE ' N' || turn || ' = ' || length(text) END"


@query(f"""WITH l AS (SELECT conv_id, turn, {_FILES} AS line FROM conversations)
    SELECT '/etc/' || conv_id || '.env' AS path, CASE turn % 3 WHEN 1 THEN 'K' ELSE 'N' END || turn AS key, CASE turn % 3 WHEN 1 THEN split_part(line, '"', 2) ELSE trim(split_part(line, '=', 2)) END AS value FROM l WHERE turn > 0 AND turn % 3 <> 0""")
def env_blocks(spark, d):
    """Configuration files told apart in a probe's output, and the settings in them."""
    lines = t(spark, d, "conversations").select("conv_id", "turn", F.expr(_FILES.replace('\\"', '"')).alias("value"))
    found = blocks(lines, "turn", by=["conv_id"]).select("path", F.explode(F.split("body", "\n")).alias("value"))
    return env_lines(found, "value", ["path"])


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_interval_counts(spark, d):
    """The events as a stream, counted by six hours with a day's grace, from all files there are."""
    schema = t(spark, d, "events").schema
    out = scratch_path(spark, "interval-counts")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = limits.interval_counts(stream, "ts", "6 hours", "1 day", "event_type")
    counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/rows")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))


def _streamed(spark, d, name, limit):
    """The rows that ``limit`` gives of the events as a stream, from all files there are."""
    schema = t(spark, d, "events").schema
    out = scratch_path(spark, name)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    limit(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("""SELECT user_id, ts, count(*) OVER w AS n, count(*) OVER w > 1 AS blocked FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)""")
def action_limiter_stream(spark, d):
    found = _streamed(spark, d, "actions", lambda e: limits.limiter(e, "user_id", "ts", 300, 1))
    return found.select(F.col("key").alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "n", "blocked")


@query(SQL["login_limiter"])
def login_limiter_stream(spark, d):
    found = _streamed(spark, d, "logins", lambda e: limits.login_limiter(e.filter("event_type IN ('error', 'signup')"), "user_id", "ts", "event_id", F.col("event_type") == "error", 86400, 3))
    return found.select(F.col("attempt").alias("event_id"), F.col("key").alias("user_id"), "recent", "blocked")


@query("""WITH e AS (SELECT *, least(event_id // 3000, 3) AS batch FROM events), f AS (SELECT *, min(batch) OVER (PARTITION BY user_id, event_type) AS first FROM e)
    SELECT event_id, user_id, event_type, batch FROM f WHERE batch = first""")
def taken_once(spark, d):
    """The events in four batches: each takes what no batch before it has taken of a user and kind."""
    table = Taken(spark, scratch_path(spark, "taken"), 16, 2)
    events = t(spark, d, "events").select("event_id", "user_id", "event_type", F.least(F.floor(F.col("event_id") / 3000), F.lit(3)).cast("long").alias("batch"))
    found = None
    for n in range(4):
        fresh = table.fresh(events.filter(F.col("batch") == n), ["user_id", "event_type"], n)
        table.take(fresh, ["user_id", "event_type"], n)
        fresh = written(fresh, "taken-rows")
        found = fresh if found is None else found.unionByName(fresh)
    return found


@query("""WITH n AS (SELECT make_timestamp(epoch_us(max(ts)) // 1000 * 1000) AS now, date_trunc('hour', max(ts)) - INTERVAL 3 DAY AS up FROM events),
    s AS (SELECT user_id, date_trunc('second', min(ts)) AS start, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 3600 * (user_id % 24 + 1) END AS every, CASE WHEN user_id % 3 = 0 THEN 60 WHEN user_id % 5 = 0 THEN 2592000 ELSE 604800 END AS grace FROM events GROUP BY 1),
    f AS (SELECT user_id, grace, start + k * every * INTERVAL 1 SECOND AS fires_at FROM s, unnest(range(0, 8760)) t(k) WHERE every > 0 OR k = 0)
    SELECT user_id, fires_at, false AS missed FROM f, n WHERE fires_at > up AND fires_at <= now
    UNION ALL SELECT user_id, max(fires_at), true FROM f, n WHERE fires_at <= up GROUP BY user_id, grace, now HAVING epoch_us(now) - epoch_us(max(fires_at)) <= grace * 1000000::BIGINT""")
def schedules_fired(spark, d):
    """Each user's schedule along the events as a stream; what was due until three days before the end was missed."""
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    plans = events.groupBy("user_id").agg(F.date_trunc("second", F.min("ts")).alias("start"))
    plans = plans.select(F.col("user_id").alias("u"), "start", F.when(F.col("user_id") % 5 == 0, 0).otherwise(3600 * (F.col("user_id") % 24 + 1)).alias("every"), (F.col("user_id") % 3 != 0).alias("late"))
    up = events.agg(F.date_format(F.date_trunc("hour", F.max("ts")) - F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    found = _streamed(spark, d, "firings", lambda e: fired(e.join(plans, F.col("user_id") == F.col("u")), "user_id", "ts", "start", "every", "late", up))
    return found.select(F.col("key").alias("user_id"), F.col("fires_at").cast("timestamp_ntz").alias("fires_at"), "missed")
