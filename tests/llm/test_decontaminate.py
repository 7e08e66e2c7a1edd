import hashlib
import random
import re

from tidemill.llm import decontaminate as D


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = [(str(i) if i is not None else "null", w[a:a + min(10, len(w))]) for i, t in items for w in [words(t)] for a in range(max(1, len(w) - 9)) if w]
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for name, x in windows:
            for a in range(len(w) - len(x) + 1):
                if w[a:a + len(x)] == x:
                    hit |= set(range(a, a + len(x)))
                    names.add(name)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    a = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, words string, n int")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, hash string")
    return sorted((tuple(r) for r in D.contamination(a, b, **how).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(0)
    vocab = ["ab", "Ça", "x1", "the", "of", "naïve", "zz"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, say(rng.randrange(0, 30))) for i in range(12)] + [(90, None), (91, "The"), (92, "the"), (None, "zz zz zz"), (93, "a a a a a a a a a a a a a a a"), (5, "of the")]
    docs = []
    for i in range(60):
        parts = [say(rng.randrange(20))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(items)[1] or "", say(rng.randrange(8))]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "a " * 3000), (None, items[0][1]), (3, docs[3][1])]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, broadcast_rows=0) == brute(docs, items)


def test_drop_and_empty(spark):
    assert run(spark, [], [(1, "x")]) == []
    assert run(spark, [(1, "x y")], []) == brute([(1, "x y")], [])
    docs = spark.createDataFrame([(1, "clean", "s"), (2, "bad words here", "s")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "bad words")], "item_id long, text string")
    assert [tuple(r) for r in D.drop_contaminated(docs, items).collect()] == [(1, "clean", "s")]
