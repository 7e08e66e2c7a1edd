"""Places in an order against plain Python, with one key that holds most rows."""

import random

import pytest

from pyspark.sql import functions as F

from tidemill.operators import ordering, runs, sync


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 9), i, rng.choice("ab"), rng.randrange(3)) for i in range(500)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows + [(None, 1000, "a", 1), (None, 1001, None, 1)], "k int, i int, v string, x int").repartition(5)


def by_key(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r[1]):
        found.setdefault(r[0], []).append(r)
    return found


def test_running_numbered_previous(events):
    rows, df = events
    rows = rows + [(None, 1000, "a", 1), (None, 1001, None, 1)]
    sums, numbers, before = {}, {}, {}
    for own in by_key(rows).values():
        total, last = 0, None
        for n, r in enumerate(own, 1):
            total += r[3]
            sums[r[1]], numbers[r[1]], before[r[1]] = total, n, last
            last = (r[2],)
    assert {r.i: r.s for r in ordering.running(df, ["k"], ["i"], F.col("x"), "s").collect()} == sums
    assert {r.i: r.n for r in ordering.numbered(df, ["k"], ["i"], "n").collect()} == numbers
    assert {r.i: tuple(r.p) if r.p else None for r in ordering.previous(df, ["k"], ["i"], "v", "p").collect()} == before
    every = {r.i: r.n for r in ordering.numbered(df, [], [F.desc("x"), F.asc("i")], "n").collect()}
    assert [i for i, _ in sorted(every.items(), key=lambda x: x[1])] == [r[1] for r in sorted(rows, key=lambda r: (-r[3], r[1]))]


def test_rises(spark):
    rows = [(i, i // 2) for i in range(300)]
    df = lambda x: spark.createDataFrame(x, "p int, q int").repartition(4)
    assert ordering.rises(df(rows), "p", "q").first().rises
    assert not ordering.rises(df(rows[:150] + [(150, 3)] + rows[151:]), "p", "q").first().rises
    assert ordering.rises(df([(1, 1)]).limit(0), "p", "q").first().rises
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("x", 0)], "k string, p int")
    assert not sync.order_changed(a, spark.createDataFrame([("b", 7), ("a", 1), ("c", 9)], "k string, p int"), "k", "p").first().changed
    assert sync.order_changed(a, spark.createDataFrame([("b", 1), ("a", 2)], "k string, p int"), "k", "p").first().changed


def test_limits_by_spans(spark):
    rng = random.Random(2)
    hits = [(rng.choice("aaab"), rng.randrange(4000)) for _ in range(400)]
    df = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(hits)], "k string, attempt int, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.attempt: r.n for r in runs.over_limit(df, "k", "ts", 60, 3).collect()}
    assert got == {i: sum(k == k2 and t - 60 < t2 <= t for k2, t2 in hits) for i, (k, t) in enumerate(hits)}
    failed = F.col("attempt") % 7 != 0
    order = sorted(range(len(hits)), key=lambda i: (hits[i][1], i))
    want = {}
    for key in "ab":
        epoch = []
        for i in order:
            if hits[i][0] == key:
                want[i] = sum(1 for j in epoch if j % 7 and hits[i][1] - 60 < hits[j][1] < hits[i][1])
                epoch = epoch + [i] if i % 7 else []
    assert {r.attempt: r.recent for r in runs.blocked_logins(df, "k", "ts", failed, 60, 3).collect()} == want


def test_sessions_islands_batches(events):
    rows, df = events
    df = df.filter("k IS NOT NULL")
    got = {r.i: (r.session, r.batch) for r in runs.batches(runs.sessions(df, "k", "i", F.col("v") == "a"), "k", "i", 3).collect()}
    islands = {}
    for k, own in by_key(rows).items():
        session, island = 0, []
        for n, r in enumerate(own):
            session += r[2] == "a"
            assert got[r[1]] == (session, n // 3)
            if not island or island[-1][0] != r[2]:
                island.append([r[2], 0, r[1], r[1]])
            island[-1][1] += 1
            island[-1][3] = r[1]
        islands |= {(k, j): tuple(x) for j, x in enumerate(island, 1)}
    assert {(r.k, r.island): (r.v, r.n, r.first, r["last"]) for r in runs.islands(df, "k", "i", "v").collect()} == islands
