import random

import numpy as np
import xxhash

from tidemill.llm import simhash as S


def brute_print(text, words=3):
    import re

    ws = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, distance=3):
    prints = [brute_print(t) for _, t in rows]
    comp = list(range(len(rows)))
    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                comp[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return sorted((d, f"{prints[i]:016x}", min(ids[root(i)])) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp long, component_id string")
    return sorted(tuple(r) for r in S.near_duplicates(df).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["ab", "Ça", "x1", "the", "of", "naïve", "zz", "q"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60, 400))) for _ in range(12)]
    rows = [(100, None), (101, ""), (102, "  \n"), (103, "one"), (104, "one  Two"), (105, "a b c")]
    for i, t in enumerate(base * 4):
        ws = t.split(" ")
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(ws[:20]) + " " + " ".join(ws[20:])))
    assert run(spark, rows) == brute(rows)


def test_links_connect_all_close_prints(spark):
    rng = np.random.default_rng(1)
    centers = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([centers] + [centers ^ sum(np.uint64(1) << b for b in rng.integers(0, 64, (3, 60)).astype(np.uint64)) for _ in range(20)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    for slice_rows in (2000, 5):
        got = {r.node: r.root for r in S.components(S.links(df, 3, slice_rows=slice_rows)).collect()}
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
        a, b = np.nonzero(np.triu(near, 1))
        x, y = S.contract(prints.view(np.int64)[a], prints.view(np.int64)[b])
        assert got == dict(zip(x.tolist(), y.tolist()))


def test_plan_finds_all_pairs():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for total in (1_000, 10**6, 10**9):
        masks = np.array(S.plan(sample, total), np.uint64)
        for _ in range(300):
            diff = np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
            assert ((diff & masks) == 0).any()


def test_thresholds_add_up():
    cost, t = S.allocate([[5, 50], [1, 2], [5, 60], [5, 70]], 0)
    assert sum(t) == 0 and cost == 11 - 0 - 0 or sum(t) == 0


def test_empty_table(spark):
    assert run(spark, [(1, "x")]) == [(1, f"{brute_print('x'):016x}", 1)]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids_and_a_very_long_text(spark):
    """A null id names a component only if nothing else does; rows that share an id are judged each for itself."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(20_000)}" for _ in range(120_000))
    rows = [(None, "some words of a text"), (5, "some words of a text"), (5, "entirely different ones stand here"), (None, "a null id alone has these"), (7, long), (3, long + " "), (3, long), (3, long)]
    got = sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    prints = {t: f"{brute_print(t):016x}" for _, t in rows}
    comp = {rows[0][1]: 5, rows[2][1]: 5, rows[3][1]: None, long: 3, long + " ": 3}
    assert got == sorted((str(d), prints[t], comp[t]) for d, t in rows)


def test_parts_outside_a_mask():
    for mask in (0, (1 << 32) - 1, 0xF0F0 << 40, (1 << 64) - 1):
        parts = [m % (1 << 64) for m in S.rest_masks(mask, 4)]
        assert sum(parts) == (1 << 64) - 1 - mask and all(a & b == 0 for i, a in enumerate(parts) for b in parts[:i])
