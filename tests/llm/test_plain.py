import random

from tests.llm import plain

from tidemill.llm import quality as Q
from tidemill.llm import toxicity as T

SYL = ["th", "er", "on", "an", "re", "ou", "in", "at", "é", "Ka"]


def word(rng):
    return "".join(rng.choice(SYL) for _ in range(rng.randrange(1, 5)))


def compared(spark, docs, labels, report, column, want, bound, threshold):
    d = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in enumerate(docs)], "at long, doc_id long, text string, lang string")
    lb = spark.createDataFrame([(k, y, y) for k, y in labels], "doc_id long, quality int, toxic int")
    # ids tell rows apart here but for the null ones, whose texts do
    got = {(r.doc_id, r.held_out): r for r in report(d, lb).filter("doc_id IS NOT NULL").collect()}
    seen = 0
    for (k, _), score in zip(docs, want):
        if k is not None:
            r = got[k, plain.held_out(k, *column)]
            assert abs(r.score - score) < bound, (k, r.score, score)
            assert abs(score - threshold) < bound or r.predicted == int(score >= threshold)
            seen += 1
    assert seen > 50


def test_quality_equals_plain_python(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(70):
        good = rng.random() < 0.6
        line = lambda: " ".join(word(rng) for _ in range(rng.randrange(3, 9))).capitalize() + "."
        junk = lambda: rng.choice(["$$$ BUY NOW 50% !!!", "click click click", "=====", " \t ", "a  a  a"])
        lines = [line() if (rng.random() < 0.9) == good else junk() for _ in range(rng.randrange(1, 7))]
        docs.append((i, rng.choice(["\n", "\r\n", "\n\n"]).join(lines)))
        labels.append((i, rng.choice([int(good)] * 9 + [None])))
    docs += [(100, ""), (101, None), (102, "\n\n"), (None, "One line.")]
    labels += [(0, 1), (None, 1), (500, 0)]
    compared(spark, docs, labels, Q.quality_report, (3, 1), plain.quality(docs, labels), 1e-6, 0.5)


def test_toxicity_equals_plain_python(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(90):
        toxic = rng.random() < 0.4
        words = [word(rng) for _ in range(rng.randrange(3, 14))] + [f"u{i}"]
        if toxic:
            words[rng.randrange(len(words) - 1)] = rng.choice(["Nasty", "nastier", "vile", "VILE"])
        docs.append((i, " ".join(words)))
        labels.append((i, rng.choice([int(toxic)] * 9 + [None])))
    docs += [(100, ""), (101, None), (102, "..."), (103, "the nastiest vile"), (None, "vile")]
    labels += [(3, 0), (None, 0), (500, 1)]
    compared(spark, docs, labels, T.toxicity_report, (4, 2), plain.toxicity(docs, labels), 1e-4, 0.3)
