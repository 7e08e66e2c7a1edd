import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from tidemill.llm import common as C
from tidemill.llm import exact_dedup as E


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=200, unique=True), st.integers(0, 40))
def test_golomb_round_trip(values, shift):
    v = np.sort(np.array(values, np.uint64) >> np.uint64(shift))
    v = np.unique(v)
    if len(v) and int(v[-1]) > len(v) << 40:
        v = v >> np.uint64(30)
        v = np.unique(v)
    if len(v) < 4 and len(v) and int(v[-1]) > 1 << 30:
        return
    assert (E.golomb_decode(E.golomb_encode(v)) == v).all()


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, keep_id int, fp string")
    return sorted((tuple(r) for r in E.exact_duplicates(df, **how).collect()), key=str)


def test_against_brute_force(spark):
    rows = [(i, ["a", "b", "", None, "long " * 9000, "A", "a "][i % 7] if i % 3 else f"only {i}") for i in range(300)] + [(5, "b"), (5, "b"), (None, "n"), (None, "n"), (None, "m"), (7, "m")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, slack=-5, broadcast_rows=0) == brute(rows)  # many false suspects, shuffled joins


def test_drop_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "a", "l"), (3, None, "m"), (4, "", "n")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in E.drop_exact_duplicates(df).select("doc_id", "source").collect()) == [(2, "l"), (4, "n")]
    assert run(spark, []) == []


def test_large_joins_shuffle_what_passes_a_bitmap(spark):
    rows = [(i, f"text {i}", "x") for i in range(4000)] + [(i, None, "n") for i in range(50)] + [(i, f"text {i % 100}", "copy") for i in range(5000, 5200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    right = C.written(spark.createDataFrame([(f"text {i}", i) for i in range(100)] + [(None, -1)], "text string, m int"), "right")
    for how, n in (("left", 4250), ("left_semi", 350), ("left_anti", 3900)):
        near, far = (sorted(map(tuple, C.joined(df, right, ["text"], how, 101, most).collect()), key=str) for most in (1000, 0))
        assert near == far and len(near) == n
    may = C.sieve(right, ["text"], 101)
    assert 350 <= df.filter(may(df)).count() < 400  # of 4,250
    kept = [sorted(map(tuple, E.drop_exact_duplicates(df, most).collect()), key=str) for most in (10**6, 0)]
    assert kept[0] == kept[1] and len(kept[0]) == 4001
    plan = E.copied_texts(df, broadcast_rows=0)[0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan or "Scan" in plan  # the groups are a written table: later jobs don't read the texts again
