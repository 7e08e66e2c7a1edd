import random

import numpy as np

from tidemill.llm import crf
from tidemill.llm import quality as Q
from tidemill.llm import toxicity as T

SYL = ["th", "er", "on", "an", "re", "ou", "in", "at"]


def word(rng):
    return "".join(rng.choice(SYL) for _ in range(rng.randrange(1, 4)))


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    chain = crf.Chain(np.array([[0.5, -0.7], [0.2, 0.9]]), 0.3)
    bounds = np.concatenate([[0], np.cumsum([0, 1, 3, 7, 0, 100, 49, 48, 150])])
    scores = rng.normal(size=bounds[-1])
    got, expected = crf.marginals(scores, bounds, chain, pairs=True)
    a, want, total = np.exp(chain.steps), [], np.zeros((2, 2))
    for x in (scores[i:j] for i, j in zip(bounds[:-1], bounds[1:]) if j > i):
        w = np.stack([np.ones(len(x)), np.exp(x)], axis=1)
        f, b = w.copy(), np.ones_like(w)
        f[0] *= [1, np.exp(chain.first)]
        for t in range(1, len(x)):
            f[t] = (f[t - 1] / f[t - 1].sum()) @ a * w[t]
        for t in range(len(x) - 2, -1, -1):
            b[t] = a @ (w[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        m = f * b
        want += list(m[:, 1] / m.sum(axis=1))
        for t in range(1, len(x)):
            z = f[t - 1][:, None] * a * (w[t] * b[t])[None]
            total += z / z.sum()
    assert np.allclose(got, want) and np.allclose(expected, total)


def toxic_corpus(n):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        ws = [word(rng) for _ in range(rng.randrange(20, 120))]
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                ws[rng.randrange(len(ws))] = rng.choice(["Slimeball", "vilepox" + word(rng)])
        docs.append((i, " ".join(ws)))
        labels.append((i, int(i % 2), int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus(600)
    odd = [(1000, None), (1001, ""), (1002, "Ünd slimeball " + "er " * 20_000), (None, "the an"), (1003, "slimeball"), (5, docs[5][1])]
    d = spark.createDataFrame([(*r, 1.0, "x") for r in docs + odd], "doc_id long, text string, score double, spans string")
    lab = spark.createDataFrame(labels + [(2000, None, None)], "doc_id long, quality int, toxic int")
    got = T.toxicity_report(d, lab).collect()
    assert len(got) == len(docs) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [i for i, *_ in docs if by[i].held_out]
    assert len(held) > 80 and np.mean([by[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    assert by[1002].predicted == by[1003].predicted == 1 and by[1002].spans == "4:13"
    assert by[1000].predicted == by[1001].predicted == by[None].predicted == 0 and all(0 <= r.score <= 1 for r in got)


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in T.toxicity_report(d, none).collect()] == [0, 0]
    assert T.toxicity_report(d.limit(0), none).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(500):
        lines = [" ".join(word(rng) for _ in range(rng.randrange(4, 20))).capitalize() + "." for _ in range(rng.randrange(1, 6))]
        good = i % 3 > 0
        if not good:
            lines = [rng.choice([x.upper() + "!!", " ".join(w + "$$$" for w in x.split()), " | ".join(x.split()), (x.split()[0] + " ") * 20]) for x in lines]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    odd = [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "Er the an.\n" * 3000), (None, "x"), (3, docs[3][1])]
    d = spark.createDataFrame([(*r, 1.0, "x") for r in docs + odd], "doc_id long, text string, score double, lines string")
    lab = spark.createDataFrame(labels + [(2000, None, None)], "doc_id long, quality int, toxic int")
    got = Q.quality_report(d, lab).collect()
    by = {r.doc_id: r for r in got}
    held = [i for i, *_ in docs if by[i].held_out]
    assert len(got) == len(docs) + len(odd) and np.mean([by[i].predicted == (i % 3 > 0) for i in held]) > 0.97
    assert by[1000].n_lines == by[1002].n_lines == 0 and by[1003].n_lines == 3000 and all(0 <= r.score <= 1 for r in got)
    kept = {r.doc_id for r in Q.drop_low_quality(d, lab).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(Q.quality_report(d, none).collect()) == 2 and Q.quality_report(d.limit(0), none).count() == 0


def test_every_tied_form_has_a_weight():
    """The last fifty toxic documents share a word that no earlier one has."""
    import random

    import numpy as np
    import pyarrow as pa

    from tidemill.llm import common as C
    from tidemill.llm import toxicity as T

    rng = random.Random(8)
    n = T.FIT_DOCS + 100
    text = lambda word: " ".join([f"w{rng.randrange(3000)}" for _ in range(20)] + [word])
    texts = [text("vile" if i < n - 50 else "late") for i in range(n)] + [text("kind") for _ in range(n)]
    model = T.train(pa.array(texts), np.arange(2 * n) < n, 0.5)
    for word in (b"vile", b"late"):
        form = C.span_hashes(C.prefix_sums(np.frombuffer(word, np.uint8)), np.array([0]), np.array([4]))[0]
        assert model.weights[1 + np.flatnonzero(model.forms == form)[0]] > 0


def likelihood(scores, labels, bounds, chain):
    """The log likelihood of the labels, less the partition function by the forward recursion."""
    total = 0.0
    for i, j in zip(bounds[:-1], bounds[1:]):
        if j > i:
            x, y = scores[i:j], labels[i:j]
            total += (x * y).sum() + chain.first * y[0] + sum(chain.steps[a, b] for a, b in zip(y[:-1], y[1:]))
            f = np.array([0.0, x[0] + chain.first])
            for t in range(1, len(x)):
                f = np.logaddexp(f[0] + chain.steps[0], f[1] + chain.steps[1]) + np.array([0.0, x[t]])
            total -= np.logaddexp(*f)
    return total


def test_gradients_by_finite_differences():
    """Observed less expected features, as fit() takes them from the marginals, is the likelihood's slope."""
    rng = np.random.default_rng(4)
    bounds = np.concatenate([[0], np.cumsum([3, 0, 60, 1, 17])])
    n = int(bounds[-1])
    feature, labels, weights = rng.integers(0, 5, n), rng.integers(0, 2, n), rng.normal(size=5)
    chain = crf.Chain(rng.normal(size=(2, 2)), 0.4)
    m, expected = crf.marginals(weights[feature], bounds, chain, pairs=True)
    seen = np.zeros((2, 2))
    inner = np.setdiff1d(np.arange(n), bounds[:-1][np.diff(bounds) > 0])
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1.0)
    slope = np.bincount(feature, labels - m, 5)
    tiny = 1e-5
    for k in range(5):
        step = np.zeros(5)
        step[k] = tiny
        want = (likelihood((weights + step)[feature], labels, bounds, chain) - likelihood((weights - step)[feature], labels, bounds, chain)) / (2 * tiny)
        assert abs(slope[k] - want) < 1e-4
    for a in (0, 1):
        for b in (0, 1):
            up, down = chain.steps.copy(), chain.steps.copy()
            up[a, b] += tiny
            down[a, b] -= tiny
            want = (likelihood(weights[feature], labels, bounds, crf.Chain(up, 0.4)) - likelihood(weights[feature], labels, bounds, crf.Chain(down, 0.4))) / (2 * tiny)
            assert abs((seen - expected)[a, b] - want) < 1e-4
    fitted, steps = crf.fit(lambda w: w[feature], lambda e: np.bincount(feature, e, 5), 5, labels, bounds, rounds=50)
    assert likelihood(fitted[feature], labels, bounds, steps) > likelihood(np.zeros(n), labels, bounds, crf.Chain())


def test_logistic_calibrates():
    rng = np.random.default_rng(5)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    beta = crf.logistic(np.column_stack([x, np.ones(4000)]), y, np.ones(4000))
    assert abs(beta[0] - 2) < 0.25 and abs(beta[1] + 1) < 0.2


def test_evidence_and_means_against_plain_ones():
    rng = np.random.default_rng(6)
    firsts = np.concatenate([[0], np.cumsum([4, 0, 1, 30])])
    p, size = rng.random(int(firsts[-1])) * 0.4, rng.integers(1, 50, int(firsts[-1])).astype(float)
    found, mean = T.evidence(p, firsts), Q.weighted(p, size, firsts)
    for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:])):
        if a == b:
            assert found[i, 0] < -20 and mean[i] == 0
            continue
        most, none = p[a:b].max(), np.prod(1 - p[a:b])
        m = (p[a:b] * size[a:b]).sum() / size[a:b].sum()
        assert np.allclose(found[i], [np.log(most / (1 - most)), np.log((1 - none) / none), 1]) and np.isclose(mean[i], np.log(m / (1 - m)))


def test_neighbours_are_those_of_the_document():
    found, firsts = np.array([[1.0], [3.0], [5.0]]), np.array([0, 2, 3])
    cuts = np.array([[2.0, 4.0] + [9.0] * (Q.PARTS - 3)])
    outside = Q.PARTS
    part, step = [0, 1, 2], Q.PARTS + 1
    want = [[part[0], outside + step, part[1] + 2 * step], [part[1], part[0] + step, outside + 2 * step], [part[2], outside + step, outside + 2 * step]]
    assert (Q.slots(found, cuts, firsts) == np.array(want) + 1).all()


def test_places_of_all_forms_in_full_slots(monkeypatch):
    monkeypatch.setattr(T, "SLOT_BITS", 3)
    forms = np.random.default_rng(7).integers(1, 2**63, 100).astype(np.uint64)
    table = T.Model(forms, np.zeros(1), crf.Chain(), np.zeros(3)).table()
    asked = np.concatenate([forms[::-1], forms + np.uint64(1), np.zeros(1, np.uint64)])
    assert (T.places([asked], table)[0] == np.concatenate([np.arange(100, 0, -1), np.zeros(101)])).all()


def test_models_do_not_depend_on_partitions(spark):
    docs, labels = toxic_corpus(300)
    docs += [(7, docs[7][1] + " again"), (9, docs[12][1])]  # rows that share an id
    lab = spark.createDataFrame(labels + [(7, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    answers = []
    for n in (1, 7):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        answers.append([sorted((str(r.doc_id), r.score) for r in f(d, lab).collect()) for f in (T.toxicity_report, Q.quality_report)])
    for one, other in zip(*answers):  # sums over a task's rows round differently
        assert [d for d, _ in one] == [d for d, _ in other] and np.allclose([x for _, x in one], [x for _, x in other], rtol=1e-6)


def test_long_training_texts_count(spark, monkeypatch):
    """Texts over the limit are learned from by pieces."""
    monkeypatch.setattr(T, "TRAIN_CHARS", 300)
    rng = random.Random(9)
    docs = [(i, " ".join([word(rng) for _ in range(200)] + (["vilepox"] * 100 if i % 2 else []))) for i in range(200)]
    docs = [(i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in docs]
    lab = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = T.toxicity_report(spark.createDataFrame(docs, "doc_id long, text string"), lab).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95


def test_weights_for_all_forms_do_as_well_as_for_the_common_ones(spark):
    from tidemill.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.filter("toxic IS NOT NULL").collect()}
    right = []
    for common in (100, toxicity.COMMON_FORMS, None):
        rows = [r for r in toxicity.toxic_spans(docs, labels, common_forms=common).filter("held_out").collect() if r.doc_id in toxic]
        right.append(sum((r.score >= 0.3) == (toxic[r.doc_id] == 1) for r in rows) / len(rows))
    assert min(right) > 0.9 and right[2] >= right[1] - 0.03, right
