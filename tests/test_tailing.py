import os
import random

import duckdb
import pyarrow.fs as pafs
import pytest

from tidemill.queries import QUERIES, SQL
from tidemill.sources import tailing as T

SF = "/root/testdata/sf0.001"
LINES = ["", "a", "é" * 9, "漢字 " * 20, "\r", "x\r", "plain text", "0123456789" * 30, "\x85  one line"]


def content(rng, n, ended=True):
    said = [rng.choice(LINES) for _ in range(n)]
    return said, "\n".join(said).encode() + (b"\n" if ended and said else b"")


def shown(text):
    return text[:-1] if text.endswith("\r") else text


@pytest.mark.parametrize("ended", [True, False])
def test_every_line_belongs_to_one_range(tmp_path, ended):
    rng = random.Random(1)
    said, raw = content(rng, 120, ended)
    if not ended and said[-1] == "":
        said = said[:-1]
    path = tmp_path / "a.log"
    path.write_bytes(raw)
    fs = pafs.LocalFileSystem()
    for size in (1, 2, 7, 64, 1000, 1 << 20):
        for block in (1, 5, 300):
            got = [(at, t.decode()) for r in T.ranges({}, {str(path): len(raw)}, size) for places, texts in T.lines_of(fs, r, block) for at, t in zip(places, texts)]
            assert [t for _, t in got] == [shown(x) for x in said]
            assert all(raw[at - 1:at] in (b"", b"\n") for at, _ in got)


def test_offsets(tmp_path):
    fs, path = pafs.LocalFileSystem(), str(tmp_path / "a")
    for raw, n in ((b"", 0), (b"abc", 0), (b"a\nbc", 2), (b"a\n\n", 3), (b"\n" + b"x" * 100, 1)):
        with open(path, "wb") as f:
            f.write(raw)
        assert all(T.complete(fs, path, len(raw), block) == n for block in (1, 3, 1000))
    assert [(r.path, r.base, r.start, r.end) for r in T.ranges({"a": 5, "b": 9, "c": 4}, {"a": 12, "b": 3, "c": 4, "d": 2}, 4)] == [("a", 5, 5, 9), ("a", 5, 9, 12), ("b", 0, 0, 3), ("d", 0, 0, 2)]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(T.Tailed)
    rng, logs, out, state = random.Random(3), tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    want = {}

    def add(name, n, ended=True):
        said, raw = content(rng, n, ended)
        with open(logs / name, "ab") as f:
            f.write(raw)
        want.setdefault(name, []).extend(said)

    def run():
        rows = spark.readStream.format("tailed").option("path", f"file://{logs}").option("rangeBytes", 100).option("blockBytes", 37).load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        got = {}
        for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r.path, r.at)):
            got.setdefault(os.path.basename(r.path), []).append(r.line)
        return got

    add("a.log", 50)
    add("b.log", 9)
    (logs / "_hidden").write_text("no\n")
    with open(logs / "a.log", "ab") as f:
        f.write("unfin".encode())
    assert run() == {k: [shown(x) for x in v] for k, v in want.items()}
    with open(logs / "a.log", "ab") as f:
        f.write("ished é\n".encode())
    want["a.log"].append("unfinished é")
    add("a.log", 30)
    add("c.log", 5)
    assert run() == {k: [shown(x) for x in v] for k, v in want.items()}
    assert run() == {k: [shown(x) for x in v] for k, v in want.items()}  # nothing new, nothing twice
    (logs / "b.log").write_text("new\n")  # rotated: shorter than what was read
    want["b.log"] = [*want["b.log"], "new"]
    assert sorted(run()["b.log"]) == sorted(shown(x) for x in want["b.log"])


def test_batch(spark, tmp_path):
    spark.dataSource.register(T.Tailed)
    load = lambda path, **o: spark.read.format("tailed").options(path=f"file://{path}", **o).load().collect()
    assert load(tmp_path / "none") == [] == load(tmp_path)
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\xff\nthree")
    (tmp_path / "b.txt").write_text("no")
    assert [(r.at, r.line) for r in load(tmp_path, suffix=".log")] == [(0, "one"), (5, "two�"), (10, "three")]
    assert [r.line for r in load(tmp_path / "b.txt")] == ["no"]


@pytest.mark.parametrize("name", ["tailed_lines"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
