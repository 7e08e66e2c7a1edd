"""Log lines as events, and what a pipeline's log says of its stages."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import scans as S
from .ordering import CHUNK, latest_in
from .records import OPENS, placed

# The tags that lines begin with, and the kinds of events that they are.
TAGS = {"warning": "warning", "warn": "warning", "db": "db", "skip": "skip", "info": "info", "dry-run": "dryrun", "plan": "plan", OPENS.strip("[] "): "summary"}
# The lines that name a pipeline's stages, end one, and tell of an error in one; a numbered success.
PIPELINE, ENDED, FAILED, NUMBERED = r"^\[start\] data-maintenance stages=([^ ]+)\s", r"(?i)^([a-z0-9_-]+)\s+\(([^)]+)\)$", r"(?i)^([a-z0-9_-]+): exit code (\d+)(?: \(([^)]+)\))?", r"^(\d+)/(\d+)\s+(\S*)"
# Keys that only a whole pipeline's summary has.
PIPELINE_KEYS = ("Stages Run", "Passed", "Failed", "All Stages")


def events(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """``by``, ``order``, kind, stage, done, total, item, seconds, elapsed, exit_code and data of log lines; lines of rules and blank ones
    are left out, and so are lines that a summary of several lines takes: it is one event, with its JSON as data (null if
    it is none).

    Stages are those that their log's last pipeline line before them lists.  Kinds: command, pipeline-start, stage-start, start,
    stage-done, pipeline-done, done, stage-error, error, warning, db, skip, info, dryrun, plan, ok, summary and verbose."""
    line = F.col(text)
    after = lambda tag: F.when(line.startswith(f"[{tag}] "), F.substr(line, F.lit(len(tag) + 4)))
    listed = F.nullif(F.regexp_extract(line, PIPELINE, 1), F.lit(""))
    stages = F.filter(F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    said = (F.trim(line) != "") & ~F.trim(line).rlike(r"^[-=]{20,}$")
    marked = placed(lines.select(by, order, text), [by], [order], text).filter(said).withColumn("_own", F.when(listed.isNotNull(), stages)).withColumnRenamed(S.BLOCK, CHUNK)
    rows = latest_in(marked, [by], [S.AT], "_own", "_stages")
    start, done, error, ok = (after(t) for t in ("start", "done", "error", "ok"))
    member = lambda c: F.coalesce(F.array_contains("_stages", c), F.lit(False))
    started = F.lower(F.trim(start))
    ended = F.lower(F.regexp_extract(done, ENDED, 1))
    failed = F.lower(F.regexp_extract(error, FAILED, 1))
    numbered_ok = F.trim(ok).rlike(r"^\d+/\d+\s+")
    tagged = F.coalesce(*(F.when(line.startswith(f"[{t}] "), F.lit(k)) for t, k in TAGS.items()))
    kind = (
        F.when(line.startswith("$ "), "command").when(F.col("_own").isNotNull(), "pipeline-start")
        .when(start.isNotNull(), F.when(member(started), "stage-start").otherwise("start"))
        .when(done.isNotNull(), F.when(member(ended), "stage-done").when(done.rlike(r"(?i)^\d+\s+stage\(s\)\s+run\b"), "pipeline-done").otherwise("done"))
        .when(error.isNotNull(), F.when(member(failed), "stage-error").otherwise("error"))
        .when(tagged.isNotNull(), tagged).when(ok.isNotNull(), F.when(numbered_ok, "ok").otherwise("verbose"))
        .otherwise("verbose")
    )
    number = lambda k: F.regexp_extract(F.trim(ok), NUMBERED, k)
    planned = F.trim(F.substring_index(after("plan"), ":", 1))
    return rows.withColumn("kind", kind).select(
        by, order, "kind", F.when(F.col("kind") == "stage-start", started).when(F.col("kind") == "stage-done", ended).when(F.col("kind") == "stage-error", failed).alias("stage"),
        F.when(F.col("kind") == "ok", number(1).try_cast("long")).alias("done"), F.when(F.col("kind") == "ok", number(2).try_cast("long")).alias("total"),
        F.when(F.col("kind") == "ok", number(3)).when(F.col("kind") == "plan", planned).alias("item"),
        F.when(F.col("kind") == "ok", F.regexp_extract(line, r"duration=([0-9.]+)s", 1).try_cast("double")).alias("seconds"),
        F.when(F.col("kind") == "stage-done", F.regexp_extract(done, ENDED, 2)).when(F.col("kind") == "stage-error", F.nullif(F.regexp_extract(error, FAILED, 3), F.lit(""))).alias("elapsed"),
        F.when(F.col("kind") == "stage-error", F.regexp_extract(error, FAILED, 2).try_cast("long")).alias("exit_code"),
        F.when(F.col("kind") == "summary", F.col("data")).alias("data"),
    )


def kinds(found: DataFrame, by: str) -> DataFrame:
    return found.groupBy(by, "kind").agg(F.count(F.lit(1)).alias("n"))


def stages(found: DataFrame, by: str, order: str, live: bool = False) -> DataFrame:
    """``by``, stage, status and first (of ``order``) of every stage that a log tells of: by its last mark succeeded, failed, or started only,
    which is running in a live log and unknown in another."""
    marks = found.filter(F.col("kind").isin("stage-start", "stage-done", "stage-error"))
    last = F.max_by("kind", order)
    status = F.when(F.col("last") == "stage-done", "succeeded").when(F.col("last") == "stage-error", "failed").otherwise("running" if live else "unknown")
    return marks.groupBy(by, "stage").agg(last.alias("last"), F.min(order).alias("first")).select(by, "stage", status.alias("status"), "first")


_OPEN = {"known": True, "stage": None, "cleared": []}


def _stage_after(effect: dict, state: str | None) -> str | None:
    return effect["stage"] if effect["known"] else None if state in effect["cleared"] else state


def _stages_after(a: dict, b: dict) -> dict:
    if b["known"] or not a["known"]:
        return b if b["known"] else {**_OPEN, "known": False, "cleared": sorted({*a["cleared"], *b["cleared"]})}
    return {**_OPEN, "stage": _stage_after(b, a["stage"])}


def in_stages(found: DataFrame, by: str, order: str, size: int = S.SIZE, fan: int = S.FAN) -> DataFrame:
    """Events with inside: the stage that is going on, which is the last one begun, unless it has ended since; null outside.
    The marks of a stage are not inside it.

    The stage is the state of a scan (see :mod:`scans`): a block of events begins a stage, or ends some and leaves the rest."""
    cut = S.blocked(written(found, "events"), [by], [order], size)  # ranges are sampled, which would make the events twice
    own = found.schema.fields
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    effect = "struct<known: boolean, stage: string, cleared: array<string>>"
    form = S.pa_type(effect)

    def look(table: pa.Table, begins: list[int]) -> pa.Table:
        marks = list(zip(table.column("kind").to_pylist(), table.column("stage").to_pylist()))
        told, inside, ended, effects = [], [], [], []
        for begin, end in zip(begins, begins[1:]):
            known, now, cleared = False, None, []
            for kind, stage in marks[begin:end]:
                if kind == "stage-start":
                    known, now = True, stage
                elif kind in ("stage-done", "stage-error"):
                    if known:
                        now = None if now == stage else now
                    elif stage not in cleared:
                        cleared = [*cleared, stage]
                mark = kind in ("stage-start", "stage-done", "stage-error", "pipeline-start")
                told.append(known or mark)
                inside.append(None if mark else now)
                ended.append([] if known or mark else cleared)
            effects.append({"known": known, "stage": now, "cleared": [] if known else cleared})
            effects.extend([None] * (end - begin - 1))
        here = pa.StructArray.from_arrays([pa.array(told, pa.bool_()), pa.array(inside, pa.string()), pa.array(ended, pa.list_(pa.string()))], fields=list(form))
        return pa.table({**{f.name: table.column(f.name) for f in own}, S.BLOCK: table.column(S.BLOCK), "_here": here, "effect": pa.array(effects, form)})

    seen = written(S.each_block(cut, [by], look, f"{kinds}, {S.BLOCK} long, _here {effect}, effect {effect}"), "stages")
    inside = F.when(F.col("_here.known"), F.col("_here.stage")).when(~F.coalesce(F.array_contains("_here.cleared", F.col("state")), F.lit(False)), F.col("state"))
    return S.reached(seen, [by], _stages_after, _stage_after, None, "string", fan).withColumn("inside", inside).select(*(f"`{f.name}`" for f in own), "inside")


def outcomes(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per ``by``: planned, completed, expected (the largest total told, else the larger of the two), pct, and the events of each outcome."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    told = found.groupBy(*by).agg(
        count("plan").alias("planned"), count("ok").alias("completed"), F.max("total").alias("_told"), count("warning").alias("warnings"), count("error", "stage-error").alias("errors"),
        count("skip").alias("skipped"), count("info").alias("info"), count("db").alias("db"), count("verbose").alias("verbose"),
    )
    expected = F.coalesce("_told", F.greatest("planned", "completed"))
    pct = F.when(F.col("expected") > 0, F.floor(F.col("completed") * F.lit(100.0) / F.col("expected") + 0.5).cast("long"))
    return told.withColumn("expected", expected).withColumn("pct", pct).select(*by, "planned", "completed", "expected", "pct", "warnings", "errors", "skipped", "info", "db", "verbose")


def stage_results(inside: DataFrame, by: str, order: str) -> DataFrame:
    """What a log says inside each stage (of :func:`in_stages`): its outcomes, and summary, the last JSON told that isn't a whole pipeline's."""
    rows = inside.filter("inside IS NOT NULL AND kind <> 'pipeline-done'")
    whole_pipeline = F.arrays_overlap(F.json_object_keys("data"), F.array(*map(F.lit, PIPELINE_KEYS)))
    told = rows.filter(F.col("data").isNotNull()).filter(~F.coalesce(whole_pipeline, F.lit(False)))
    last = told.groupBy(by, "inside").agg(F.max(F.struct(F.col(order).alias("at"), "data")).alias("_last"))
    return S.joined(outcomes(rows, [by, "inside"]), last, [by, "inside"], []).withColumn("summary", F.col("_last.data")).withColumnRenamed("inside", "stage").drop("_last")


def chunk(text: Column, offset: int = 0, size: int = 200_000) -> Column:
    """``size`` bytes of a log from ``offset`` on; characters that are cut become U+FFFD."""
    return F.make_valid_utf8(F.substring(text.cast("binary"), offset + 1, size).cast("string"))


def last_bytes(text: Column, size: int = 200_000) -> Column:
    """The last ``size`` bytes of a log."""
    raw = text.cast("binary")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.make_valid_utf8(F.substr(raw, F.octet_length(text) - size + 1, F.lit(size)).cast("string")))
