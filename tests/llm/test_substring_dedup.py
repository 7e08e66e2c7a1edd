import hashlib
import random

import numpy as np
import pytest

from tidemill.llm import substring_dedup as S


def brute(rows, length):
    """doc_id, bytes, removed, runs and hash of what stays, by a table of all strings."""
    first = {}
    enc = [(d, (t or "").encode()) for d, t in rows]
    for d, t in enc:
        rank = S._LAST if d is None else d
        for i in range(len(t) - length + 1):
            s = t[i:i + length]
            first[s] = min(first.get(s, rank), rank)
    out = []
    for d, t in enc:
        rank = S._LAST if d is None else d
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i:i + length]] < rank:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, rank int, sha string, runs string")
    return sorted((tuple(r) for r in S.substring_report(df, **how).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["ab", "Ça", "x1", "the", "of", "naïve", "zz", "q", "aaaa", "\n", "😀"]
    words = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [words(rng.randrange(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [words(rng.randrange(0, 40))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared)[rng.randrange(10):], words(rng.randrange(0, 20))]
        rows.append((rng.randrange(n), " ".join(parts)))
    return rows + rows[:5] + [(i, rows[0][1]) for i in range(200, 204)]


def test_against_brute_force(spark):
    odd = [(900, None), (901, ""), (902, "short"), (None, "x" * 300), (903, "x" * 200), (904, "x" * 200 + "y"), (904, "x" * 90), (905, "ab" * 400), (906, "b" + "ab" * 30), (None, "ab" * 60)]
    rows = corpus(1, 60) + odd
    assert run(spark, rows) == brute(rows, 50)


def test_hot_buckets_and_other_lengths(spark):
    rows = corpus(2, 50)
    assert run(spark, rows, hot_rows=3) == brute(rows, 50)
    assert run(spark, rows, length=30, q=12) == brute(rows, 30)


def test_documents_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 3_000)
    rows = corpus(3, 50) + [(900, None), (None, "x" * 300), (903, "x" * 200)]
    assert run(spark, rows, hot_rows=3, bitmap_bits=1) == brute(rows, 50)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_refinement_names_equal_strings():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, (40, 76)).astype(np.uint8)
    text[20:] = text[:20]
    text[20:, 70] ^= 1
    ids = S.string_buckets(text, 50, 27)
    seen = {}
    for i in range(40):
        for c in range(27):
            assert seen.setdefault((c, text[i].tobytes()[c:c + 50]), ids[i, c]) == ids[i, c]
    assert len(set(seen.values())) == len(seen)


def test_bytes_decide_where_hashes_meet(spark, monkeypatch):
    """All contexts have one hash."""
    monkeypatch.setattr(S.C, "span_hashes", lambda sums, a, b, f=S.C.span_hashes: f(sums, a, b) if len(a) == 0 or int(b[0]) - int(a[0]) == S.Q else np.zeros(len(a), np.uint64))
    docs = corpus(4, 40)
    batch = S.pa.record_batch({"rank": S.pa.array([d for d, _ in docs]), "part": S.pa.array([0] * len(docs), S.pa.int32()), "text": S.pa.array([t for _, t in docs])})
    rows = next(S._row_batches(iter([batch]), lambda fp: np.ones(len(fp), bool), 60, 50, 28))
    raw = {d: [t.encode() for e, t in docs if e == d] for d, _ in docs}
    for before, text, members in zip(rows.column("before").to_pylist(), rows.column("bytes").to_pylist(), rows.column("members").to_pylist()):
        for rank, _, pos in np.frombuffer(members, S._MEMBER).tolist():
            assert any(t[pos - before:pos - before + len(text)] == text for t in raw[rank])


def test_a_text_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 2_000)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, long), (2, long[10_000:12_000] + "z" * 60), (3, "z" * 55 + long[29_000:]), (4, long + "!")]
    assert run(spark, rows) == brute(rows, 50)
    assert run(spark, rows, hot_rows=2) == brute(rows, 50)


def test_a_million_bytes(spark):
    rng = np.random.default_rng(6)
    long = bytes(rng.integers(97, 123, 1_200_000).astype(np.uint8)).decode()
    rows = [(1, long), (2, long[500_000:500_400]), (3, "q" + long[1_000_000:])]
    assert run(spark, rows) == [(1, 1_200_000, 0, 0, hashlib.sha256(long.encode()).hexdigest()), (2, 400, 400, 1, hashlib.sha256(b"").hexdigest()), (3, 200_001, 200_000, 1, hashlib.sha256(b"q").hexdigest())]


def test_ids_of_another_type_are_refused(spark):
    with pytest.raises(TypeError, match="number the documents"):
        S.repeated_runs(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_hot_intervals_that_meet_leave_as_one(spark, monkeypatch):
    """Copies of one text: some 140 anchors each lie in hot buckets, and one run a document leaves its task."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij ") for _ in range(2_000))
    rows = [(i, f"{i} " * 30 + base + f" {i * i}" * 20) for i in range(60)]
    seen = []
    monkeypatch.setattr(S, "_runs", lambda intervals, f=S._runs: (seen.append(intervals.count()), f(intervals))[1])
    assert run(spark, rows, hot_rows=2) == brute(rows, 50)
    assert 59 <= seen[0] < 200
    monkeypatch.setattr(S, "MET", 5)
    assert run(spark, rows, hot_rows=2) == brute(rows, 50)


def test_met_intervals_are_those_of_plain_marks():
    rng = np.random.default_rng(9)
    rank, part, a = rng.integers(0, 4, 300), rng.integers(0, 2, 300).astype(np.int32), rng.integers(0, 900, 300)
    b = a + rng.integers(1, 9, 300)
    got = list(zip(*(x.tolist() for x in S.met(rank, part, a, b))))
    marks = {(r, p): np.zeros(1000, bool) for r, p in zip(rank.tolist(), part.tolist())}
    for r, p, x, y in zip(rank.tolist(), part.tolist(), a.tolist(), b.tolist()):
        marks[r, p][x:y] = True
    for r, p, x, y in got:
        assert marks[r, p][x:y].all() and not marks[r, p][x - 1:x].any() and not marks[r, p][y]
    assert sum(y - x for _, _, x, y in got) == sum(int(m.sum()) for m in marks.values()) and len(set(got)) == len(got)
    assert all(len(x) == 0 for x in S.met(*(np.zeros(0, np.int64) for _ in range(4))))
