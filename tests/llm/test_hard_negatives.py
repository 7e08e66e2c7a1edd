import math
import random

import duckdb
import numpy as np
import pytest

from tidemill.llm import hard_negatives as H
from tidemill.llm.queries import SQL, op11_hard_negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank int"


def brute(rows):
    by_id = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x])
        by_id[i] = min(row, by_id.get(i, row))
    found = []
    for a, (label, x) in by_id.items():
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in by_id.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            inside = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            found += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(inside)]
    return sorted(found)


def made(seed, n=700, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), rng.choice([-0.5, 0.25])]) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2])) for i in rng.sample(range(-200, 1500), n)]
    same = rows[0][1]
    rows += [(i, same, i % 2) for i in range(2000, 2000 + n // 3)]  # one vector in a third of all rows
    rows += [(3000, None, 1), (3050, [1.0] * dims, None), (3100, [math.nan] * dims, 1), (3150, [math.inf, *[0.0] * (dims - 1)], 1), (3151, [None, 1.0], 1), (None, [1.0] * dims, 1)]
    rows += [(3200, [], 1), (3250, [1.0], 1), (3300, [0.5] * (dims + 2), 2), (3350, [0.0] * dims, 2), (3400, [-1.0] * dims, 3)]
    rows += rows[:50] + [(rows[50][0], rows[51][1], 2)]  # repeated rows, and an id with two vectors
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "slot", "cells", "broadcast_bytes"), [(8192, 2048, 64, 1 << 20), (100, 5, 4, 1 << 20), (37, 8, 256, 0), (64, 3, 2, 0)])
def test_against_brute_force(spark, block, slot, cells, broadcast_bytes):
    rows = made(block)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = H.hard_negatives(table, block, slot, cells, broadcast_bytes)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_salted_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCKS_A_KEY", 2)
    rows = made(9, 300)
    got = H.hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), 40, 4, 16, 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x, q = rng.normal(0, 32, (3000, 16)).astype(np.int32), rng.normal(0, 32, (5, 16)).astype(np.int32)
    cell, low, high = H.approximated(x, 64)
    least, most = H.bounds(q, cell, low, high)
    score = q @ x.T
    assert (least <= score).all() and (score <= most).all() and (most - least).mean() < 0.5 * score.std()
    scored = []
    keep, H.exact_scores = H.exact_scores, lambda a, b, i, j: scored.append(len(i)) or keep(a, b, i, j)
    try:
        block = H._Block({"ids": np.arange(3000).tobytes(), "labels": np.zeros(3000, np.int64).tobytes(), "x": x.tobytes(), "cell": cell.tobytes(), "low": low.tobytes(), "high": high.tobytes()}, 16, np.int32, np.int32, 64)
        slot = H._Slot({"anchors": np.arange(5).tobytes(), "anchor_labels": np.zeros(5, np.int64).tobytes(), "anchor_x": q.tobytes()}, 16, np.int32, np.int32)
        list(H.block_positives(slot, block, 5))
    finally:
        H.exact_scores = keep
    assert sum(scored) < 0.05 * score.size


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(empty).collect() == [] == H.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "", 1), (50, None, 1, "", 1)], SCHEMA)).collect()
    with pytest.raises(ValueError, match="62 bits"):
        H.hard_negatives(spark.createDataFrame([(50, [1e30], 1, "", 1)], SCHEMA))


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got, want = op11_hard_negatives(spark, SF), db.sql(SQL["op11_hard_negatives"])
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) > 100 and rows == sorted(want.fetchall())
