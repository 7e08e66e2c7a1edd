import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import filters as L
from tidemill.sources.writers import to_rotate

KNOWN = "field string, name string"


def test_keys_of_any_name_and_brackets_in_values(spark):
    names = spark.createDataFrame([("tags", "a"), ("tags", "b]c")], KNOWN)
    rows = [("x", 'tags.name IN ["a", "z"]'), ("y", 'tags.name IN ["b]c", "nope"]'), ("z", None), ("w", 'TAGS.name not  in [q] AND colour.name IN ["r"]')]
    for key in ("k", "_c", "name", "list"):
        found = L.errors(spark.createDataFrame(rows, f"{key} string, f string"), key, "f", names)
        assert found.columns == [key, "error", "part"]
        assert sorted(map(tuple, found.collect())) == [("w", "unknown_field", 'colour.name IN ["r"]'), ("w", "unknown_name", "q"), ("x", "unknown_name", "z"), ("y", "not_a_clause", 'tags.name IN ["b]c", "nope"]')]
    with pytest.raises(ValueError, match="called part"):
        L.errors(spark.createDataFrame(rows, "part string, f string"), "part", "f", names)


@pytest.mark.parametrize("seed", range(3))
def test_division_equals_arrays(spark, seed):
    rng = random.Random(seed)
    links = [(rng.choice([None, *range(12)]), rng.choice([None, *range(100)]), rng.choice("abc")) for _ in range(400)] + [(3, i % 100, "a") for i in range(300)]
    records = spark.createDataFrame([(i if i < 15 else None, "x") for i in range(17)], "id int, n string")
    table = spark.createDataFrame(links, "r int, v int, w string")
    tags, many = (json.dumps([str(x) for x in rng.sample(range(100), n)]) for n in (3, 80))
    texts = [f"tools.id CONTAINS ALL {tags} AND tags.name NOT IN [b]", f"tools.id IN {many} AND tools.id NOT IN {tags}", f"tools.id CONTAINS ALL {many}", 'tools.id IN ["none", "5"]', 'tools.id CONTAINS ALL ["none", "5"]', "tags.name CONTAINS ALL [a, b, a]"]
    arrays = records.join(table.groupBy("r").agg(F.collect_set(F.col("v").cast("string")).alias("vs"), F.collect_set("w").alias("ws")), F.col("id") == F.col("r"), "left")
    for text in texts:
        clauses, errors = L.parse(text)
        assert not errors
        want = arrays.filter(L.column(clauses, {"tools": F.col("vs"), "tags": F.col("ws")})).select("id", "n")
        got = L.divided(records, "id", clauses, {"tools": (table, "r", "v"), "tags": (table, "r", "w")})
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_division_reads_wanted_rows_only(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    clauses, _ = L.parse('tools.id IN ["3", "17"]')
    plan = L.divided(orders, "o_orderkey", clauses, {"tools": (lines, "l_orderkey", "l_suppkey")})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_suppkey, [17,3])" in plan or "PushedFilters: [In(l_suppkey, [3,17])" in plan
    assert "collect_set" not in plan and "collect_list" not in plan


def test_rotation_counts_files_of_one_stamp(spark):
    files = spark.createDataFrame([("a", 3, "f1"), ("a", 2, "f2"), ("a", 2, "f3"), ("a", 2, "f4"), ("b", None, "g1"), ("b", 1, "g2"), ("b", 1, "g0")], "by string, stamp int, file string")
    assert sorted(r.file for r in to_rotate(files, "by", "stamp", 2).collect()) == ["f3", "f4", "g1"]
    assert sorted(r.file for r in to_rotate(files, "by", "stamp", 9).collect()) == []
