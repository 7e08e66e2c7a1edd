import json
import random

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemill.queries import QUERIES, SQL
from tidemill.streaming import sliding as L

SF = "/root/testdata/sf0.001"


def failures(seen, us, attempt, span):
    """Failures in the window before (us, attempt), and since the last success."""
    earlier = sorted(h for h in seen if h[:2] < (us, attempt))
    last = max((i for i, h in enumerate(earlier) if not h[2]), default=-1)
    return sum(f and us - span < u < us for u, _, f in earlier[last + 1:])


def test_buckets_against_all_hits():
    for seed in range(20):
        rng = random.Random(seed)
        span = rng.choice([1, 7, 64, 1000])
        kept, index, seen = {}, b"", []
        for _ in range(6):
            new = sorted({(rng.randrange(0, 3000), rng.randrange(5), rng.random() < 0.7) for _ in range(rng.randrange(1, 60))})
            seen += new
            b = L.Buckets(index, span, lambda k: kept[k])
            b.add(np.array(new, L._HIT))
            for us, attempt, _ in new:
                assert b.count(us, attempt) == failures(seen, us, attempt, span)
            only = L.Buckets(b.packed(), span, lambda k, b=b: b.at_hand[k].tobytes() if k in b.at_hand else kept[k])
            for us, _, _ in new:
                assert only.count(us, None) == sum(f for u, _, f in seen if us - span < u <= us)
            kept.update({k: b.at_hand[k].tobytes() for k in b.changed})
            index = b.packed()


def test_a_hot_key_costs_its_new_events_only():
    span, kept, loads, index = 3_200_000, {}, [], b""
    for batch in range(40):
        b = L.Buckets(index, span, lambda k: loads.append(k) or kept[k])
        new = np.array([(batch * 100_000 + i, 0, True) for i in range(0, 100_000, 10)], L._HIT)
        b.add(new)
        loads.clear()
        last = b.count(int(new[-1]["us"]), None)
        assert last == min((batch + 1) * 10_000, 320_000) and len(loads) <= 2  # of up to 33 buckets
        for k in b.drop_before(int(new[-1]["us"]) - span):
            kept.pop(k)
        assert sum(len(b.at_hand[k]) for k in b.changed) <= 2 * len(new)
        kept.update({k: b.at_hand[k].tobytes() for k in b.changed})
        index = b.packed()
    assert len(kept) <= L.PARTS + 3


def test_streams_in_several_batches(spark, tmp_path):
    rng, src, out = random.Random(5), tmp_path / "in", []
    src.mkdir()
    seen, want, newest = [], [], 0
    for i in range(5):
        rows = []
        for j in range(60):
            s = i * 120 + rng.choice([rng.randrange(120), rng.randrange(-100, 120)])
            rows.append((rng.choice("hhhhab"), max(s, 0), i * 100 + j, rng.random() < 0.8))
        late = [r for r in rows if i and r[1] < newest - 600]
        (src / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "ts": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", "a": a, "f": f}) for k, s, a, f in rows))
        rows = [r for r in rows if r not in late]
        newest = max([newest, *(r[1] for r in rows)])
        seen += rows
        want += [(a, failures([(u * 10**6, b, g) for q, u, b, g in seen if q == k], s * 10**6, a, 30 * 10**6)) for k, s, a, _ in rows]
        events = spark.readStream.schema("k string, ts timestamp, a long, f boolean").json(str(src))
        found = L.login_limiter(events, "k", "ts", "a", F.col("f"), 30, 3)
        found.writeStream.foreachBatch(lambda b, _: out.extend((r.attempt, r.recent) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == sorted(want)


@pytest.mark.parametrize("name", ["action_limiter_stream", "login_limiter_stream"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
