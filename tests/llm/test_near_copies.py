import random
import re

import numpy as np

import corpus_pipeline as P
from tidemill.llm import near_copies as N


def sets(text, words=5):
    ws = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    found, left = [sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if left[i] != left[j] and similar(found[i], found[j]):
                low, high = sorted((left[i], left[j]))
                left = [low if x == high else x for x in left]
    ids = {}
    for (d, _), x in zip(rows, left):
        ids[x] = min(d, ids.get(x, d))
    return sorted(d for (d, _), x in zip(rows, left) if ids[x] == d)


def edited(rng, text, edits):
    ws = text.split(" ")
    for i in rng.sample(range(len(ws)), edits):
        ws[i] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


def texts(rng, n, words):
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(words)) for _ in range(n)]


def stage(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    out = P.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(r.doc_id for r in out.collect())


def test_copies_from_0_8_on(spark):
    """Edits of 1 to 9 words in 300: similarities on both sides of 0.8, and most of them more than three bits apart."""
    rng = random.Random(5)
    base = texts(rng, 40, 300)
    rows = list(enumerate([*base, *(edited(rng, t, 1 + i % 9) for i, t in enumerate(base)), None, "", " \n", "one", "One ", "one two", "a b c d"]))
    want = brute(rows)
    assert 45 < len(want) < 80
    assert stage(spark, rows) == want


def test_boilerplate_is_no_link(spark):
    """One line that fills over half of each text gives all of them one fingerprint."""
    rng = random.Random(6)
    rows = [(i, "all of us agree to the terms of use " * 30 + t) for i, t in enumerate(texts(rng, 30, 40))]
    assert stage(spark, rows) == brute(rows) == list(range(30))


def test_large_groups_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS", 0)
    rng = random.Random(7)
    base = texts(rng, 3, 200)
    rows = list(enumerate(edited(rng, t, i % 4) for t in base for i in range(40)))
    assert stage(spark, rows) == brute(rows)


def test_sketches_never_tell_similar_sets_apart():
    rng = np.random.default_rng(8)
    raw, sets_ = [], []
    for n in (1, 5, 15, 16, 17, 100, 250, 260, 1000):
        base = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        sets_ += [np.unique(base[: n + k]) for k in {0, n // 5, n // 3}]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets_])])
    raw = N.sketches(np.concatenate(sets_), cuts)
    known, size = N.Sketches(raw), np.diff(cuts)
    told = 0
    for i, x in enumerate(sets_):
        for j, y in enumerate(sets_):
            both = len(np.intersect1d(x, y))
            near = known.near(np.array([i]), np.array([j]), N.unlike(size[[i]], size[[j]]))[0]
            assert near or 5 * both < 4 * (len(x) + len(y) - both)
            told += not near
    assert told > 200


def test_slices(spark, monkeypatch):
    """Keys of more documents than a task compares at once."""
    monkeypatch.setattr(N, "SLICE", 7)
    monkeypatch.setattr(N, "STARS", 0)
    rng = random.Random(9)
    rows = list(enumerate(edited(rng, t, i % 6) for t in texts(rng, 2, 200) for i in range(30)))
    assert stage(spark, rows) == brute(rows)


def test_fingerprints_propose_first(spark, monkeypatch):
    """Without any band, what differs in three bits of the fingerprint at most is linked, if the sets are similar."""
    rng = random.Random(11)
    base = texts(rng, 12, 400)
    rows = list(enumerate([*base, *(t + " end" for t in base)]))
    asked = []
    monkeypatch.setattr(N.simhash, "links", lambda prints, f=N.simhash.links: (asked.append(prints.count()), f(prints))[1])
    monkeypatch.setattr(N, "band_keys", lambda h, cuts: np.arange(1, 1 + N.BANDS * int((np.diff(cuts) > 0).sum())).reshape(-1, N.BANDS).astype(np.uint64) + (h[:1] << np.uint64(20)))
    assert stage(spark, rows) == brute(rows) == list(range(12)) and asked


def test_equal_fingerprints_of_other_sets_are_no_link(spark, monkeypatch):
    monkeypatch.setattr(N.simhash, "majority", lambda h, cuts: np.zeros(len(cuts) - 1, np.uint64))
    rng = random.Random(12)
    base = texts(rng, 10, 100)
    rows = list(enumerate([*base, *(edited(rng, t, 1) for t in base)]))
    assert stage(spark, rows) == brute(rows)
