import random

import duckdb
import pytest

from tidemill.queries import QUERIES, SQL
from tidemill.streaming import taken as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_segments_cover_all_earlier_batches_once(fan):
    def batches(level, k):
        return range(k * fan**level, (k + 1) * fan**level)

    made = set()
    for n in range(150):
        made |= set(T.merged_by(n, fan))
        faced = T.facing(n, fan)
        assert sorted(b for s in faced for b in batches(*s)) == list(range(n))
        assert all(level == 0 or (level, k) in made for level, k in faced)
        gone = {(level - 1, k * fan + i) for m in range(n) for level, k in T.merged_by(m, fan) for i in range(fan)}
        assert not gone & set(faced)
        assert len(faced) <= (fan - 1) * (len(bin(n)))


def test_against_a_set(spark, tmp_path):
    rng, table, seen = random.Random(1), T.Taken(spark, f"file://{tmp_path}/t", buckets=4, fan=2), set()
    for n in range(7):
        made = [(rng.choice([None, *"abcdefghij"]), rng.choice([None, 1, 2]), i) for i in range(12)]
        rows = spark.createDataFrame(made, "k string, v int, i int")
        for _ in range(2 if n in (3, 4) else 1):  # run again
            fresh = table.fresh(rows, ["k", "v"], n)
            got = sorted((r.i for r in fresh.collect()))
            assert got == sorted(i for k, v, i in made if (k, v) not in seen)
            table.take(fresh, ["k", "v"], n)
        seen |= {(k, v) for k, v, _ in made}
    assert not (tmp_path / "t/level-0/0").exists() and (tmp_path / "t/level-0/6").exists()  # merged ones go


def test_what_a_batch_reads_does_not_grow_with_history(spark, tmp_path):
    table = T.Taken(spark, f"file://{tmp_path}/t", buckets=8, fan=4)
    for n in range(9):
        size = 3000 if n < 8 else 20  # a long history, then a small batch
        rows = spark.range(n * 3000, n * 3000 + size).withColumnRenamed("id", "k")
        assert table.fresh(rows, ["k"], n).count() == size
        table.take(rows, ["k"], n)
    filters, buckets = table.read[-1]
    assert len(T.facing(8, 4)) == 2 and filters <= 16 and buckets <= 2  # of 24,000 keys in 16 buckets
    assert table.fresh(spark.createDataFrame([(5,), (10**9,)], "k long"), ["k"], 9).collect() == [(10**9,)] and table.read[-1][1] == 1


def test_empty_batches(spark, tmp_path):
    table = T.Taken(spark, f"file://{tmp_path}/t", buckets=4, fan=2)
    none, one = spark.createDataFrame([], "k string"), spark.createDataFrame([("a",)], "k string")
    for n, rows in enumerate((none, one, none, one, none)):
        fresh = table.fresh(rows, ["k"], n)
        assert fresh.count() == (1 if n == 1 else 0)
        table.take(fresh, ["k"], n)


@pytest.mark.parametrize("name", ["taken_once"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
