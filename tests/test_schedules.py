import json
import random

import duckdb
import pytest

from tidemill.queries import QUERIES, SQL
from tidemill.streaming import schedules as S

SF = "/root/testdata/sf0.001"
DAY = 86_400


def test_due_against_all_times():
    rng = random.Random(1)
    for _ in range(3000):
        start, every, last, now, end = rng.randrange(50), rng.choice([0, 1, 3, 7]), rng.randrange(-5, 80), rng.randrange(90), rng.choice([10**6, rng.randrange(90)])
        times = [t for t in ([start] if not every else range(start, 100, every)) if last < t <= min(now, end)]
        n, first = S.due(start, every, last, now, end)
        assert n == len(times) and (not times or first == times[0])


def test_a_stream_over_a_gap(spark, tmp_path):
    """Three batches: schedules, then time goes on, then further; one is changed on the way."""
    src, out = tmp_path / "in", []
    src.mkdir()
    base = 1_704_067_200  # 2024-01-01
    up = base + 10 * DAY

    def row(key, at, start=None, every=None, missed=None, end=None):
        say = lambda x: None if x is None else f"{x}"
        return json.dumps({"k": key, "t": at, "s": start, "e": every, "m": missed, "z": end, "n": say(key)})

    plans = {"often": (base, 3600, True, None), "seldom": (base + 50, 9 * DAY, True, None), "strict": (base, 7200, False, None), "once": (base + DAY, None, True, None), "late once": (up + DAY, None, False, None), "over": (base, DAY, True, base + 5 * DAY)}
    batches = [[row(k, base + 5, *p) for k, p in plans.items()], [row("clock", up + 600)], [row("clock", up + 2 * DAY)], [row("often", up + 2 * DAY + 60, base, 7 * 3600, True)], [row("clock", up + 3 * DAY)]]
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(rows))
        events = spark.readStream.schema("k string, t long, s long, e long, m boolean, z long").json(str(src)).selectExpr("k", "timestamp_seconds(t) AS t", "timestamp_seconds(s) AS s", "e", "m", "timestamp_seconds(z) AS z")
        found = S.fired(events, "k", "t", "s", "e", "m", "2024-01-11 00:00:00", "z")
        found.selectExpr("key", "unix_seconds(fires_at) AS at", "missed").writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    got = {}
    for key, at, missed in out:
        got.setdefault(key, []).append((at, missed))
    assert len(out) == len(set(out)) and "clock" not in got
    assert sorted(got["often"]) == sorted([(up, True), *((up + k * 3600, False) for k in range(1, 49)), *((t, False) for t in range(base, up + 3 * DAY + 1, 7 * 3600) if t > up + 2 * DAY)])
    assert got["seldom"] == [(base + 50 + 9 * DAY, True)]
    assert sorted(got["strict"]) == [(up + k * 7200, False) for k in range(1, 37)]  # a minute of grace is over
    assert got["once"] == [(base + DAY, True)] and got["late once"] == [(up + DAY, False)]
    assert got["over"] == [(base + 5 * DAY, True)]


def _streamed(spark, tmp_path, kind, batches, up):
    """What batches of (key, at, start, every) fire, and the stream's last progress."""
    src, out = tmp_path / "in", []
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip("ktse", r))) for r in rows))
        events = spark.readStream.schema("k string, t long, s long, e long").json(str(src)).selectExpr(f"{kind} AS k", "timestamp_seconds(t) AS t", "timestamp_seconds(s) AS s", "e")
        found = S.fired(events.selectExpr("*", "true AS m"), "k", "t", "s", "e", "m", up)
        query = found.selectExpr("key", "unix_seconds(fires_at) AS at", "missed").writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    return out, query.lastProgress


@pytest.mark.parametrize("kind", ["CAST(k AS LONG)", "CAST(k AS BINARY)", "timestamp_micros(CAST(k AS LONG))"])
def test_schedules_that_share_a_bucket(spark, tmp_path, monkeypatch, kind):
    """Many keys, one of them null; each fires at its own times, though two buckets hold all, and a changed one goes on from where it was."""
    monkeypatch.setattr(S, "BUCKETS", 2, raising=False)
    base = 1_704_067_200  # 2024-01-01
    keys = [None, *(str(2**53 + i) for i in range(40))]
    plans = {k: (base + 37 * i, 3600 * (i % 5)) for i, k in enumerate(keys)}
    changed = {k: (s, 5400) for k, (s, e) in list(plans.items())[:10] if e}
    batches = [[(k, base + 5, *p) for k, p in plans.items()], [(keys[1], base + DAY, None, None)], [(k, base + DAY + 60, *p) for k, p in changed.items()], [(keys[1], base + 2 * DAY, None, None)]]
    got, progress = _streamed(spark, tmp_path, kind, batches, "2024-01-01 00:00:00")
    plain = lambda k: bytes(k) if isinstance(k, bytearray) else k
    value = {plain(r[0]): r[1] for r in spark.createDataFrame([(k,) for k in keys], "k string").selectExpr(f"{kind} AS v", "k").collect()}
    want = set()
    for k, (start, every) in plans.items():
        times = range(start, base + 2 * DAY + 1, every) if every else [start]
        if k in changed:  # from where its last firing left it, which is the day's end
            then = range(start, base + 2 * DAY + 1, 5400)
            times = [*(t for t in times if t <= base + DAY), *(t for t in then if t > base + DAY)]
        want |= {(k, t, False) for t in times if t > base} | ({(k, start, True)} if start <= base else set())
    assert sorted(((value[plain(k)], *x) for k, *x in got), key=str) == sorted(want, key=str)
    assert progress["stateOperators"][0]["numRowsTotal"] < len(keys)  # a few for each bucket, where each key had its own


@pytest.mark.parametrize("name", ["schedules_fired"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows and rows == sorted(want.fetchall())
