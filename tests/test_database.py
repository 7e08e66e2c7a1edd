import random
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.queries import QUERIES, SQL
from tidemill.sources import database as D

SF = "/root/testdata/sf0.001"


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE r (id INTEGER PRIMARY KEY, y TEXT, q REAL CHECK (q < 1000), n INTEGER NOT NULL DEFAULT 0)")
        c.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", [(i, f"y{i}", i / 2, i) for i in range(200)])
    return path


def rows(path, table="r"):
    with sqlite3.connect(path) as c:
        return sorted(c.execute(f'SELECT * FROM "{table}"').fetchall())


def tables(path):
    with sqlite3.connect(path) as c:
        return {n for (n,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def plan(spark, made, kinds="id long, y string, q double", parts=4):
    return spark.createDataFrame(made, kinds).repartition(parts)


def test_update(spark, db):
    made = [(i, f"new{i}", 1.5) for i in range(0, 300, 3)] + [(None, "lost", 1.0)]
    assert D.changed(plan(spark, made), url=db, table="r", keys="id") == (100, 1)
    want = [(i, f"new{i}", 1.5, i) if i % 3 == 0 else (i, f"y{i}", i / 2, i) for i in range(200)]
    assert rows(db) == want and tables(db) == {"r", "_writes"}


def test_partial_update_of_several_rows_a_key(spark, db):
    made = [(1, "a", None, 1), (1, None, 7.0, 2), (1, "b", None, 3), (2, None, None, 1), (3, "c", 9.0, 5), (3, "d", None, 4)]
    got = D.changed(plan(spark, made, "id long, y string, q double, at int"), order="at", url=db, table="r", keys="id", partial=True)
    assert got == (3, 0)
    assert rows(db)[1:4] == [(1, "b", 7.0, 1), (2, "y2", 1.0, 2), (3, "c", 9.0, 3)]
    got = D.changed(plan(spark, made, "id long, y string, q double, at int"), order="at", url=db, table="r", keys="id")
    assert got == (3, 0) and rows(db)[1:4] == [(1, "b", None, 1), (2, None, None, 2), (3, "c", 9.0, 3)]


def test_upsert_and_insert_missing(spark, db):
    made = [(199, "x", 1.0), (200, "y", 2.0)]
    assert D.changed(plan(spark, made), url=db, table="r", keys="id", mode="insert_missing") == (2, 0)
    assert rows(db)[-2:] == [(199, "y199", 99.5, 199), (200, "y", 2.0, 0)]
    assert D.changed(plan(spark, [(199, None, 3.0), (201, "z", None)]), url=db, table="r", keys="id", mode="upsert", partial=True) == (2, 0)
    assert rows(db)[-3:] == [(199, "y199", 3.0, 199), (200, "y", 2.0, 0), (201, "z", None, 0)]


def test_rows_that_the_table_refuses_fail_alone(spark, db):
    made = [(i, "new", 5000.0 if i in (7, 9) else 1.0) for i in range(20)] + [(None, "x", 1.0)]
    assert D.changed(plan(spark, made), url=db, table="r", keys="id") == (18, 3)
    assert rows(db)[7] == (7, "y7", 3.5, 7) and rows(db)[8] == (8, "new", 1.0, 8)


def test_a_failing_task_leaves_the_table_as_it_was(spark, db):
    before = rows(db)
    broken = plan(spark, [(i, "new", 1.0) for i in range(100)]).withColumn("y", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("y")))
    with pytest.raises(Exception, match="broken"):
        D.changed(broken, url=db, table="r", keys="id", token="t1")
    assert rows(db) == before and tables(db) == {"r"}
    with pytest.raises(Exception, match="several rows"):
        D.changed(plan(spark, [(1, "a", 1.0), (1, "b", 1.0)]), url=db, table="r", keys="id", token="t2")
    assert rows(db) == before and tables(db) <= {"r", "_writes"}
    assert D.changed(plan(spark, [(1, "a", 1.0)]), url=db, table="r", keys="id", token="t1") == (1, 0) == D.outcome("t1", url=db)
    with pytest.raises(Exception, match="committed before"):
        D.changed(plan(spark, [(1, "b", 1.0)]), url=db, table="r", keys="id", token="t1")
    assert rows(db)[1] == (1, "a", 1.0, 1)


def test_attempts_that_do_not_count_are_left_out(db):
    from pyspark.sql.types import StructType

    writer = D._Writer({"url": db, "table": "r", "keys": "id", "token": "w"}, StructType.fromDDL("id long, y string"))
    first, again = writer.write(iter([(1, "lost"), (2, "lost")])), writer.write(iter([(1, "won")]))
    assert (first.rows, again.rows) == (2, 1)
    writer.commit([again, None])
    assert rows(db)[1:3] == [(1, "won", 0.5, 1), (2, "y2", 1.0, 2)]


def test_read_by_spans(spark, db):
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE e (id INTEGER, y TEXT)")
    for parts in ("1", "7"):
        got = D.read(spark, "n long, y string", url=db, table="r", key="id", parts=parts)
        assert sorted(map(tuple, got.collect())) == sorted((i, f"y{i}") for i in range(200))
        assert D.read(spark, "id long", url=db, table="e", key="id", parts=parts).collect() == []
    with sqlite3.connect(db) as c:
        c.executemany("INSERT INTO e VALUES (?, ?)", [(None, "none"), (5, "a"), (-3, "b")])
    assert sorted(r.y for r in D.read(spark, "y string", url=db, table="e", key="id", parts="3").collect()) == ["a", "b", "none"]


def test_names_are_checked(db):
    with pytest.raises(ValueError, match="safe in SQL"):
        D._name('r"; DROP TABLE r; --')


def test_many_tasks_write_at_once(spark, db):
    rng = random.Random(1)
    made = [(i, str(rng.random()), 1.0) for i in range(200)]
    assert D.changed(plan(spark, made, parts=16), url=db, table="r", keys="id") == (200, 0)
    assert [r[:2] for r in rows(db)] == [m[:2] for m in made]


@pytest.mark.parametrize("name", ["yields_written", "rows_upserted"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "events", "supplier", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
