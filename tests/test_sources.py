import json

from pyspark.sql import functions as F

from tidemill.plans import stages
from tidemill.sources import readers, writers
from tidemill.streaming import limits


def two_pages(number, size):
    """A service of three items on two pages, one of which is no row."""
    return json.dumps([{"items": [{"id": "1", "name": "a"}, "junk"]}, [{"id": "2", "name": "b", "slug": "s"}]][number])


def test_paged_source(spark):
    spark.dataSource.register(readers.Paged)
    df = spark.read.format("paged").option("fetcher", "tests.test_sources:two_pages").option("pages", 2).load()
    assert sorted((r.id, r.name, r.slug) for r in df.collect()) == [("1", "a", None), ("2", "b", "s")]


def test_catalog_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"slug": "x", "tags": [{"name": "t"}]}]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"slug": "y", "recipeYieldQuantity": 2}], "next": None}))
    got = sorted((r.slug, r.recipeYieldQuantity, [t.name for t in r.tags or []]) for r in readers.catalog(spark, str(tmp_path)).collect())
    assert got == [("x", None, ["t"]), ("y", 2.0, [])]
    assert readers.json_table(spark, str(tmp_path / "none.json"), "name string").count() == 0


def test_env(spark):
    text = "x\n__CFG_FILE__:/a\nexport A='1'\n# B=2\n C = \"x=y\"\n__CFG_FILE__:/b\nD=4\n__CFG_FILE__:/a\nA=9"
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "i int, value string")
    found = readers.blocks(lines, "i")
    assert sorted(r.path for r in found.collect()) == ["/a", "/b"]
    each = found.select("path", F.explode(F.split("body", "\n")).alias("value"))
    assert sorted(tuple(r) for r in readers.env_lines(each, "value", ["path"]).collect()) == [("/a", "A", "1"), ("/a", "C", "x=y"), ("/b", "D", "4")]


def test_writes_are_gated(spark, tmp_path):
    df = spark.range(3)
    assert not writers.replaced(df, str(tmp_path / "t"), writers.Mode(apply=True))
    assert writers.replaced(df, str(tmp_path / "t"), writers.Mode(apply=True, dry_run=False))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    files = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "name string, stamp int")
    assert sorted(tuple(r) for r in writers.to_rotate(files, "name", "stamp", 3).collect()) == [("a", 0), ("a", 1)]


def test_stages(spark):
    t = {"names": spark.createDataFrame([("a",), ("b",)], "name string")}

    def drop(tables):
        plan = tables["names"].filter("name = 'a'")
        return plan, {"names": tables["names"].join(plan, "name", "left_anti")}

    def fail(tables):
        raise ValueError("no")

    dry = stages.run({"junk": drop, "names": fail, "dedup": drop}, t)
    assert [(o.stage, o.status, o.planned) for o in dry.outcomes] == [("dedup", "ok", 1), ("junk", "ok", 1), ("names", "failed", 0)]
    wet = stages.run({"junk": drop, "dedup": drop}, t, mode=writers.Mode(True, False))
    assert [o.planned for o in wet.outcomes] == [1, 0] and wet.tables["names"].count() == 1
    assert wet.summary(spark).count() == 2
    assert stages.stage_list(" Junk, names,junk") == ["junk", "names"] and stages.stage_list(None) == stages.ORDER


def stream(spark, folder, write):
    """The events of a folder as a stream, until all are read."""
    events = spark.readStream.schema("k string, ts timestamp, v string").json(str(folder))
    q = write(events).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"k": "u", "ts": f"2024-01-01T00:00:{s:02d}Z", "v": str(s)}) for s in (0, 10, 20, 50)))
    out = []
    take = lambda b, i: out.extend(tuple(r) for r in b.collect())
    stream(spark, src, lambda e: limits.limiter(e, "k", "ts", 30, 2).select("n", "blocked").writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", str(tmp_path / "c1")))
    assert sorted(out) == [(1, False), (1, False), (2, False), (3, True)] or sorted(out) == [(1, False), (2, False), (2, False), (3, True)]
    out.clear()
    stream(spark, src, lambda e: limits.run_states(e, "k", "ts", "v").select("k", "status").writeStream.foreachBatch(take).outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")))
    assert out == [("u", "50")]


def test_late_events_count_those_before_them(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    at = lambda s: json.dumps({"k": "u", "ts": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", "v": str(s)})
    write = lambda e: limits.limiter(e, "k", "ts", 30, 9).selectExpr("unix_seconds(ts) % 3600 AS s", "n").writeStream.foreachBatch(lambda b, i: out.extend(tuple(r) for r in b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    for i, times in enumerate(([10, 50, 60], [20, 55], [100])):
        (src / f"{i}.json").write_text("\n".join(map(at, times)))
        stream(spark, src, write)
    assert sorted(out) == [(10, 1), (20, 2), (50, 1), (55, 2), (60, 2), (100, 1)]


def test_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda k, v: json.dumps({"k": k, "ts": "2024-01-01T00:00:00Z", "v": v})
    taken = []
    go = lambda: stream(spark, src, lambda e: limits.incremental(e, str(tmp_path / "state"), "k", F.col("v"), lambda b: taken.extend((r.k, r.v) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")))
    (src / "1.json").write_text(line("a", "1") + "\n" + line("b", "1"))
    go()
    (src / "2.json").write_text(line("a", "1") + "\n" + line("b", "2"))
    go()
    assert sorted(taken) == [("a", "1"), ("b", "1"), ("b", "2")]
