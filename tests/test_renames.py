import random

import duckdb
import pytest

from tidemill.operators import renames as R
from tidemill.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def sequence(rows):
    """One rename after the other, against the names that are taken at its turn."""
    holders = {}
    for _, _, name, _ in rows:
        if name is not None:
            holders[name] = holders.get(name, 0) + 1
    shared = {n for n, k in holders.items() if k > 1}
    taken, found = set(holders), {}
    for o, k, name, wanted in sorted((r for r in rows if r[1] is not None and r[2] and r[3] and r[2] != r[3]), key=lambda r: (r[0], r[1])):
        if wanted in taken:
            found[k] = "conflict"
        else:
            if name not in shared:
                taken.discard(name)
            taken.add(wanted)
            found[k] = "rename"
    return found


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "o int, id int, slug string, want string, n int, done string")
    got = R.in_turn(df.repartition(3), "id", "o", "slug", "want").collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: r.action for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_against_the_sequence(spark, monkeypatch, seed):
    monkeypatch.setattr(R, "HOT", 3)
    rng = random.Random(seed)
    n = 120
    order = rng.sample(range(n), n)
    rows = [(order[i], i, f"s{i}", rng.choice([f"s{i - 1}", f"s{rng.randrange(n + 20)}", f"s{i}", "s5", "new", "", None, f"s{i + 1}"])) for i in range(n)]
    rows += [(0, 500, None, "x"), (0, 501, "", "y"), (0, None, "s200", "z"), (1, 502, "twin", "t1"), (2, 503, "twin", "t2"), (3, 504, "own", "twin"), (4, 505, "own2", "s200")]
    assert run(spark, rows) == sequence(rows)


def test_a_chain_over_all_rows_and_cycles(spark):
    chain = [(i, i, f"s{i}", f"s{i - 1}") for i in range(1, 200)]
    assert run(spark, chain) == sequence(chain) == {i: "rename" for i in range(1, 200)}
    backwards = [(-i, i, f"s{i}", f"s{i - 1}") for i in range(1, 50)]
    assert run(spark, backwards) == sequence(backwards) == {i: "rename" if i == 1 else "conflict" for i in range(1, 50)}
    cycle = [(i, i, f"s{i}", f"s{(i + 1) % 5}") for i in range(5)]
    assert run(spark, cycle) == sequence(cycle) == {i: "conflict" for i in range(5)}
    assert run(spark, []) == {}


@pytest.mark.parametrize("name", ["renames_in_turn", "rename_outcome"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows and rows == sorted(want.fetchall())
