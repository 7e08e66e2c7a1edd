import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import replies
from tidemill.operators import search as S
from tidemill.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
QUESTIONS = ["ab", "", "  ABC ", "bca a", "aaaa", "é漢", "É漢字", "nowhere at all", "c%_", "b" * 40]


@pytest.mark.parametrize(("block", "keys"), [(50_000, 2000), (20, 3)])
def test_equal_to_the_scan(spark, tmp_path, monkeypatch, block, keys):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "KEYS", keys)
    rng = random.Random(block)
    rows = [(i, "".join(rng.choice("aAbBc %_é漢字") for _ in range(rng.randrange(60))), rng.choice([None, "", "abc", "Bca A"])) for i in range(300)] + [(999, "b" * 50_000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, a string, b string, key int")
    S.build(df.repartition(3), "id", ["a", "b"], f"file://{tmp_path}/i")
    for q in QUESTIONS:
        want = sorted(r.id for r in replies.searched(df, ["a", "b"], q).select("id").collect())
        assert sorted(r.key for r in S.found(spark, f"file://{tmp_path}/i", q).collect()) == want, q


def test_a_question_reads_its_rarest_lists(spark, tmp_path):
    df = spark.range(3000).select("id", F.concat(F.lit("common words in all "), F.when(F.col("id") % 1000 == 7, "zebra").otherwise("horse")).alias("a"))
    S.build(df, "id", ["a"], f"file://{tmp_path}/i")
    found = S.found(spark, f"file://{tmp_path}/i", "all ZEBRA")
    assert sorted(r.key for r in found.collect()) == [7, 1007, 2007]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", In(key, [" in plan and "Join" not in plan


def test_empty_and_keys(spark, tmp_path):
    S.build(spark.createDataFrame([(None, "abc"), ("k", None), ("l", "xyz")], "id string, a string"), "id", ["a"], f"file://{tmp_path}/i")
    assert [r.key for r in S.found(spark, f"file://{tmp_path}/i", "xyz").collect()] == ["l"] and S.found(spark, f"file://{tmp_path}/i", "abc").collect() == []
    S.build(spark.createDataFrame([], "id string, a string"), "id", ["a"], f"file://{tmp_path}/e")
    assert S.found(spark, f"file://{tmp_path}/e", "abc").collect() == [] == S.found(spark, f"file://{tmp_path}/e", "a").collect()


def test_origin(spark):
    runs = spark.createDataFrame([(1, None), (2, ""), (3, "s")], "id int, schedule string")
    got = {o: sorted(r.id for r in S.of_origin(runs, "schedule", o).collect()) for o in ("manual", "scheduled", "all")}
    assert got == {"manual": [1, 2], "scheduled": [3], "all": [1, 2, 3]}


@pytest.mark.parametrize("name", ["search_indexed", "runs_shown"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows and rows == sorted(want.fetchall())


def test_trigrams_leave_a_task_with_their_records(spark, tmp_path, monkeypatch):
    """As many rows as a block has trigrams, not one for each record that holds them; bytes cut blocks too."""
    texts = ["abc abc", "", "abcd", "é漢字é漢字", "ab", "\x00\x00\x00\U0010ffff"]
    words, bounds, rows = S.posting_lists(texts)
    assert {w: rows[a:b].tolist() for w, a, b in zip(words, bounds, bounds[1:])} == {w: [i for i, x in enumerate(texts) if w in x] for w in {w for x in texts for w in S.trigrams(x)}}
    df = spark.range(900).select("id", F.lit("the same words in all").alias("a"))
    S.build(df.coalesce(1), "id", ["a"], f"file://{tmp_path}/i")
    lists = spark.read.parquet(f"file://{tmp_path}/i/lists")
    assert lists.filter("gram = 'the'").agg(F.sum("n")).first()[0] == 900 and lists.count() < 30 * lists.select("block").distinct().count()
    monkeypatch.setattr(S, "BYTES", 50)
    S.build(df.coalesce(1), "id", ["a"], f"file://{tmp_path}/j")
    assert spark.read.parquet(f"file://{tmp_path}/j/lists").select("block").distinct().count() >= 450 and S.found(spark, f"file://{tmp_path}/j", "SAME").count() == 900
