import json
import random

import duckdb
import pytest

from tidemill.operators import logs, records, scans
from tidemill.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def sequential(lines):
    """(place, data) of the lines that stand for themselves, one line after the other."""
    found, i = [], 0
    while i < len(lines):
        line, took, data = lines[i] or "", 1, None
        if line.startswith("[summary] "):
            text = line[10:].strip(records.BLANK)
            while True:
                try:
                    json.loads(text.strip(records.BLANK), parse_constant=records._refuse)
                    data = text.strip(records.BLANK)
                    break
                except ValueError:
                    if took > 50 or i + took >= len(lines):
                        break
                    text += "\n" + (lines[i + took] or "")
                    took += 1
        found.append((i, data))
        i += took
    return found


PARTS = ["[summary] {", "[summary] ", "[summary] [1,", "}", '"a": 1', '"a": 2}', ", 3]", "2]", "[summary] 12", "[summary] {} x", "", None, "{", "[summary] NaN", "-1", "plain", "[start] x", " ﻿[summary] no", '[summary] {"k": "v"}', '"b": [', "]", "}  ", "  {}"]


def logs_of(rng, sizes):
    return {k: [rng.choice(PARTS) if rng.random() < 0.7 else f'"n{rng.randrange(9)}": {rng.randrange(9)},' for _ in range(n)] for k, n in sizes.items()}


@pytest.mark.parametrize(("size", "fan"), [(50, 2), (64, 3), (4096, 4096)])
def test_records_equal_a_sequential_reader(spark, size, fan):
    rng = random.Random(size)
    made = logs_of(rng, {"hot": 900, "b": 51, "c": 50, "d": 1, "e": 130, None: 77})
    made["open"] = ["[summary] {"] * 160  # every line opens a record, none closes
    made["deep"] = ["[summary] " + "[" * 100_000, *["x"] * 60]
    lines = spark.createDataFrame([(k, i, x) for k, v in made.items() for i, x in enumerate(v)], "log string, n long, line string")
    got = {}
    for r in records.whole(lines.repartition(5), ["log"], ["n"], "line", size, fan).collect():
        got.setdefault(r.log, []).append((r.n, r.data))
    want = {k: sequential(v) for k, v in made.items() if k != "deep"}
    want["deep"] = [(0, None), *((i, None) for i in range(51, 61))]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sum(d is not None for v in want.values() for _, d in v) > 5
    assert records.whole(lines.limit(0), ["log"], ["n"], "line").collect() == []


def test_effects_compose():
    rng = random.Random(2)
    for _ in range(50):
        steps = [rng.choice([1, 1, 1, 2, 5, 51]) for _ in range(rng.randrange(1, 200))]
        cut = rng.randrange(1, len(steps)) if len(steps) > 1 else 1
        whole, _ = records.effect(steps)
        if steps[cut:]:
            assert records.compose(records.effect(steps[:cut])[0], records.effect(steps[cut:])[0]) == whole


def test_names_that_are_made_here_are_refused(spark):
    with pytest.raises(ValueError, match="made here"):
        records.whole(spark.createDataFrame([(1, 1, "x", "y")], "log int, n int, line string, data string"), ["log"], ["n"], "line")


def test_a_block_must_hold_what_it_looks_ahead(spark):
    with pytest.raises(ValueError, match="shorter"):
        scans.with_next(spark.range(1), 10, 50)


@pytest.mark.parametrize(("size", "fan"), [(1, 2), (7, 3), (4096, 4096)])
def test_stages_equal_a_sequential_reader(spark, size, fan):
    rng = random.Random(7 + size)
    rows, want = [], {}
    for log, n in (("a", 200), ("b", 3), (None, 40)):
        now = None
        for i in range(n):
            kind = rng.choice(["stage-start", "stage-done", "stage-error", "pipeline-start", "ok", "verbose", "verbose", "summary"])
            stage = rng.choice("xyz") if kind.startswith("stage") else None
            now = stage if kind == "stage-start" else None if stage and stage == now else now
            want[log, i] = None if stage or kind == "pipeline-start" else now
            rows.append((log, i, kind, stage))
    found = spark.createDataFrame(rows, "log string, n long, kind string, stage string")
    assert {(r.log, r.n): r.inside for r in logs.in_stages(found.repartition(3), "log", "n", size, fan).collect()} == want


def test_states_reach_only_logs_of_several_blocks(spark, monkeypatch):
    """Logs of one block, nearly all there are, each cost a call in one task before."""
    asked, entering = [], scans.entering
    monkeypatch.setattr(scans, "entering", lambda effects, by, *a: asked.append({r[0] for r in effects.select(*by).distinct().collect()}) or entering(effects, by, *a))
    made = logs_of(random.Random(4), {"hot": 180, None: 61, **{f"l{i}": 9 for i in range(40)}})
    lines = spark.createDataFrame([(k, i, x) for k, v in made.items() for i, x in enumerate(v)], "log string, n long, line string")
    got = {}
    for r in records.whole(lines, ["log"], ["n"], "line", 60).collect():
        got.setdefault(r.log, []).append((r.n, r.data))
    assert asked == [{"hot", None}] and {k: sorted(v) for k, v in got.items()} == {k: sequential(v) for k, v in made.items()}


def test_blocks_meet_batches_of_any_length(spark):
    lines = spark.range(700).selectExpr("id % 7 AS log", "id AS n", "IF(id % 5 = 0, '[summary] {', IF(id % 3 = 0, '}', 'x')) AS line")
    made, got = {}, {}
    for r in lines.orderBy("n").collect():
        made.setdefault(r.log, []).append(r.line)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 64, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            rows = records.whole(lines, ["log"], ["n"], "line", 60).selectExpr("log", "n div 7 AS n", "data").collect()
            got[n] = {k: sorted((r.n, r.data) for r in rows if r.log == k) for k in made}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(x == {k: sequential(v) for k, v in made.items()} for x in got.values())


def test_stages_are_known_across_blocks_and_in_a_log_without_a_name(spark):
    lists = {0: "a,b", 4500: " , ", 4600: "B, c", 9000: "a"}
    text = [f"[start] data-maintenance stages={lists[i].replace(' ', '')} x" if i in lists else ["", None, "[start] a", "[start] b", "[done] c (1s)", "-" * 20][i % 6] for i in range(10_000)]
    lines = spark.createDataFrame([(k, i, x) for k in (None, 1) for i, x in enumerate(text)], "log int, n long, line string")
    known, want = [], []
    for i, x in enumerate(text):
        if i in lists:
            known = [y.strip().lower() for y in lists[i].split(",")]
            want.append((i, "pipeline-start"))
        elif x and x[0] == "[":
            kind, name = x[1:].split()[:2]
            want.append((i, f"{'stage-' if name in known else ''}{kind[:-1]}"))
    got = logs.events(lines, "log", "n", "line").collect()
    assert [sorted((r.n, r.kind) for r in got if r.log == k) for k in (None, 1)] == [want, want]


@pytest.mark.parametrize("name", ["log_records", "log_stage_owners", "log_outcomes", "log_stage_results"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_what_a_summary_takes_is_no_event(spark):
    text = ["[start] data-maintenance stages=a,b x", "[start] a", "[summary] {", '"n": 1', "}", "[ok] 1/4 s", "[done] a (2s)", "[summary] {", "[start] b", *["x"] * 49, "[error] b: exit code 3 (1m)"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "log int, n long, line string")
    events = logs.events(lines, "log", "n", "line")
    got = [(r.n, r.kind, r.stage, r.data) for r in events.orderBy("n").collect()]
    assert got == [(0, "pipeline-start", None, None), (1, "stage-start", "a", None), (2, "summary", None, '{\n"n": 1\n}'), (5, "ok", None, None), (6, "stage-done", "a", None), (7, "summary", None, None), (58, "stage-error", "b", None)]
    assert [(r.elapsed, r.exit_code) for r in events.filter("n IN (6, 58)").orderBy("n").collect()] == [("2s", None), ("1m", 3)]
    result = logs.stage_results(logs.in_stages(events, "log", "n"), "log", "n").collect()
    assert [(r.stage, r.completed, r.expected, r.pct, r.summary) for r in result] == [("a", 1, 4, 25, '{\n"n": 1\n}')]
