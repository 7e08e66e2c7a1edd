"""Logs whose summaries run over several lines; a third of all lines are one log's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs
from .registry import query, t

# One record in five of those that are opened never closes, and takes what comes after it.
_LINES = r"""CASE event_id % 13 WHEN 0 THEN array('[start] data-maintenance stages=dedup,names  go') WHEN 1 THEN array('[start] dedup') WHEN 2 THEN array('[ok] ' || (event_id % 40) || '/40 item-' || user_id || ' duration=1.5s')
    WHEN 3 THEN array('[done] dedup (3s)') WHEN 4 THEN array('[start] names') WHEN 5 THEN array('[error] names: exit code 2 (4s)') WHEN 6 THEN array('[warn] slow', '[skip] it')
    WHEN 7 THEN array('[summary] {', '"made": ' || event_id || ',', CASE WHEN event_id % 5 = 0 THEN '[start] names' ELSE '"of": [1,' END, ' 2]', '}') WHEN 8 THEN array('[summary] {"All Stages": 2}') WHEN 9 THEN array('[plan] x: y')
    WHEN 10 THEN array('[summary]  ', '', '  [' || user_id || ',', '2]  ') WHEN 11 THEN array('[info] a', '[db] b') ELSE array('plain') END"""
_LOG = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END"

_TOP = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT log, n, line, row_number() OVER (PARTITION BY log ORDER BY n) AS pos FROM (
        SELECT {_LOG} AS log, event_id * 8 + k AS n, lines[k] AS line FROM (SELECT *, {_LINES.replace('array(', 'list_value(')} AS lines FROM events), unnest(range(1, len(lines) + 1)) AS u(k))),
    b AS (SELECT *, list(line) OVER (PARTITION BY log ORDER BY pos ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING) AS buf FROM l QUALIFY line LIKE '[summary] %'),
    j AS (SELECT log, pos, list_transform(range(1, len(buf) + 1), lambda k: substr(array_to_string(buf[:k], chr(10)), 11)) AS tries FROM b),
    o AS MATERIALIZED (SELECT log, pos, len(tries) AS most, list_filter(range(1, len(tries) + 1), lambda k: json_valid(tries[k]))[1] AS k, tries FROM j),
    x AS MATERIALIZED (SELECT o.log, o.pos, coalesce(o.k, o.most) AS k, CASE WHEN o.k IS NOT NULL THEN o.tries[o.k] END AS data, p.pos AS nx FROM o ASOF LEFT JOIN o AS p ON o.log = p.log AND o.pos + coalesce(o.k, o.most) <= p.pos),
    c AS (SELECT x.* FROM x SEMI JOIN (SELECT log, min(pos) AS pos FROM x GROUP BY log) USING (log, pos) UNION ALL SELECT x.* FROM c JOIN x ON x.log = c.log AND x.pos = c.nx),
    top AS (SELECT l.log, l.n, l.line, CASE WHEN l.pos = c.pos THEN regexp_replace(c.data, '\\s', '', 'g') END AS data FROM l ASOF LEFT JOIN c ON l.log = c.log AND l.pos >= c.pos WHERE c.pos IS NULL OR l.pos = c.pos OR l.pos >= c.pos + c.k),
    s AS (SELECT *, coalesce(sum(CAST(line LIKE '[start] data%' AS INT)) OVER (PARTITION BY log ORDER BY n), 0) > 0 AS known FROM top),
    e AS (SELECT log, n, data, CASE WHEN line LIKE '[start] data%' THEN 'pipeline-start' WHEN line LIKE '[start]%' THEN CASE WHEN known THEN 'stage-start' ELSE 'start' END WHEN line LIKE '[done]%' THEN CASE WHEN known THEN 'stage-done' ELSE 'done' END
            WHEN line LIKE '[error]%' THEN CASE WHEN known THEN 'stage-error' ELSE 'error' END WHEN line LIKE '[warn]%' THEN 'warning' WHEN line LIKE '[%] %' THEN split_part(substr(line, 2), ']', 1) ELSE 'verbose' END AS kind,
            CASE WHEN known AND line IN ('[start] dedup', '[done] dedup (3s)') THEN 'dedup' WHEN known AND line LIKE '%names%' AND line NOT LIKE '%data%' THEN 'names' END AS stage,
            CASE WHEN line LIKE '[ok]%' THEN 40 END AS total FROM s WHERE line <> ''),
    r AS (SELECT *, sum(CAST(kind = 'stage-start' AS INT)) OVER (PARTITION BY log ORDER BY n) AS session FROM e),
    f AS (SELECT *, first_value(stage) OVER w AS begun FROM r WINDOW w AS (PARTITION BY log, session ORDER BY n)),
    i AS (SELECT *, CASE WHEN session > 0 AND kind NOT IN ('stage-start', 'stage-done', 'stage-error', 'pipeline-start')
            AND coalesce(max(CAST(kind IN ('stage-done', 'stage-error') AND stage = begun AS INT)) OVER (PARTITION BY log, session ORDER BY n), 0) = 0 THEN begun END AS inside FROM f)"""
_SUMS = """count(*) FILTER (kind = 'plan') AS planned, count(*) FILTER (kind = 'ok') AS completed, coalesce(max(total), greatest(count(*) FILTER (kind = 'plan'), count(*) FILTER (kind = 'ok'))) AS expected,
    count(*) FILTER (kind = 'warning') AS warnings, count(*) FILTER (kind IN ('error', 'stage-error')) AS errors, count(*) FILTER (kind = 'skip') AS skipped, count(*) FILTER (kind = 'info') AS info,
    count(*) FILTER (kind = 'db') AS db, count(*) FILTER (kind = 'verbose') AS verbose"""


def _events(spark, d):
    rows = t(spark, d, "events").select(F.expr(_LOG).alias("log"), "event_id", F.posexplode(F.expr(_LINES)).alias("k", "line"))
    return logs.events(rows.select("log", (F.col("event_id") * 8 + F.col("k") + 1).alias("n"), "line"), "log", "n", "line")


@query(f"{_TOP} SELECT log, n, kind, stage, data FROM e")
def log_records(spark, d):
    return _events(spark, d).select("log", "n", "kind", "stage", F.regexp_replace("data", r"\s", "").alias("data"))


@query(f"{_TOP} SELECT log, n, kind, inside FROM i")
def log_stage_owners(spark, d):
    return logs.in_stages(_events(spark, d), "log", "n").select("log", "n", "kind", "inside")


@query(f"{_TOP}, g AS (SELECT log, {_SUMS} FROM e GROUP BY 1) SELECT *, CASE WHEN expected > 0 THEN CAST(floor(completed * 100.0::DOUBLE / expected + 0.5) AS BIGINT) END AS pct FROM g")
def log_outcomes(spark, d):
    return logs.outcomes(_events(spark, d), ["log"])


@query(f"""{_TOP}, g AS (SELECT log, inside AS stage, {_SUMS}, arg_max(data, n) FILTER (data IS NOT NULL AND data NOT LIKE '%AllStages%') AS summary FROM i WHERE inside IS NOT NULL GROUP BY 1, 2)
    SELECT *, CASE WHEN expected > 0 THEN CAST(floor(completed * 100.0::DOUBLE / expected + 0.5) AS BIGINT) END AS pct FROM g""")
def log_stage_results(spark, d):
    return logs.stage_results(logs.in_stages(_events(spark, d), "log", "n"), "log", "n").withColumn("summary", F.regexp_replace("summary", r"\s", ""))
