"""The two chain classifiers in plain Python, one position after the other: fit, marginals, calibration and scores."""

import math
import re
import zlib
from collections import Counter

import numpy as np


def held_out(doc_id, n, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == remainder


def sample(docs, labels, n, remainder):
    """The labelled rows that aren't held out, as (text, label), and the share of label 1 among all labels that aren't (one
    without a doc_id is a label too, but of no row)."""
    known = {}
    for i, y in labels:
        if y in (0, 1) and not held_out(i, n, remainder):
            known[i] = max(y, known.get(i, 0))
    rows = [(t, known[i]) for i, t in docs if i is not None and i in known and t is not None]
    return rows, sum(known.values()) / len(known)


class Chain:
    """Weights by feature, four transitions and the first position's score."""

    def __init__(self, bias):
        self.weights, self.steps, self.first = {"bias": bias}, [[0.0, 0.0], [0.0, 0.0]], 0.0

    def score(self, features):
        return self.weights["bias"] + sum(self.weights.get(f, 0.0) for f in features)

    def marginals(self, row):
        """The chance of label 1 at each position, and the expected transitions."""
        x = [(1.0, math.exp(max(-30.0, min(30.0, self.score(f))))) for f in row]
        a = [[math.exp(v) for v in r] for r in self.steps]
        forward, backward = [], [(1.0, 1.0)] * len(x)
        for t, w in enumerate(x):
            m = [w[0], w[1] * math.exp(self.first)] if t == 0 else [(forward[-1][0] * a[0][k] + forward[-1][1] * a[1][k]) * w[k] for k in (0, 1)]
            forward.append((m[0] / sum(m), m[1] / sum(m)))
        for t in range(len(x) - 2, -1, -1):
            m = [sum(a[k][j] * x[t + 1][j] * backward[t + 1][j] for j in (0, 1)) for k in (0, 1)]
            backward[t] = (m[0] / sum(m), m[1] / sum(m))
        both = [(f[0] * b[0], f[1] * b[1]) for f, b in zip(forward, backward)]
        expected = [[0.0, 0.0], [0.0, 0.0]]
        for t in range(1, len(x)):
            joint = [[forward[t - 1][i] * a[i][j] * x[t][j] * backward[t][j] for j in (0, 1)] for i in (0, 1)]
            total = sum(map(sum, joint))
            for i in (0, 1):
                for j in (0, 1):
                    expected[i][j] += joint[i][j] / total
        return [p[1] / (p[0] + p[1]) for p in both], expected

    def fit(self, rows, labels, weigh, rounds, rate, decay):
        """Steps along the gradient, each weight's divided by the root of its sum of squares."""
        n = sum(map(len, rows))
        names = {"bias"} | {f for row in rows for fs in row for f in fs}
        self.weights = {f: self.weights.get(f, 0.0) for f in names}
        grown, grown_steps, grown_first = dict.fromkeys(names, 1e-8), [[1e-8] * 2, [1e-8] * 2], 1e-8
        for _ in range(rounds):
            slope, steps, first = dict.fromkeys(names, 0.0), [[0.0] * 2, [0.0] * 2], 0.0
            for row, own, count in zip(rows, labels, weigh):
                if not row:
                    continue
                p, expected = self.marginals(row)
                for t, fs in enumerate(row):
                    e = (own[t] - p[t]) * count[t]
                    slope["bias"] += e
                    for f in fs:
                        slope[f] += e
                    if t:
                        steps[own[t - 1]][own[t]] += 1
                for i in (0, 1):
                    for j in (0, 1):
                        steps[i][j] -= expected[i][j]
                first += own[0] - p[0]
            for f in names:
                g = slope[f] / n - decay * self.weights[f]
                grown[f] += g * g
                self.weights[f] += rate * g / math.sqrt(grown[f])
            for i in (0, 1):
                for j in (0, 1):
                    g = steps[i][j] / n - decay * self.steps[i][j]
                    grown_steps[i][j] += g * g
                    self.steps[i][j] += rate * g / math.sqrt(grown_steps[i][j])
            g = first / n - decay * self.first
            grown_first += g * g
            self.first += rate * g / math.sqrt(grown_first)


def calibrated(x, y, prior, ridge):
    """A logistic regression of y on the columns of x by Newton's steps, weighted to the prior."""
    share = sum(y) / len(y)
    weigh = [prior / share if v else (1 - prior) / (1 - share) for v in y]
    beta = np.zeros(len(x[0]))
    for _ in range(30):
        slope, curve = -ridge * beta, ridge * np.eye(len(beta))
        for row, v, w in zip(np.array(x), y, weigh):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(row @ beta)))))
            slope = slope + w * (v - p) * row
            curve = curve + w * max(p * (1 - p), 1e-9) * np.outer(row, row)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -5, 5)
        if max(abs(step)) < 1e-8:
            break
    return beta


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


# --- quality ------------------------------------------------------------------------

def lines_of(text):
    """The numbers of each line, and the lines' bytes."""
    raw = [x for x in re.split(rb"[\n\r]+", (text or "").encode()) if x]
    words = [[w.lower() for w in re.split(rb"[ \t\x0b\x0c]+", x) if w] for x in raw]
    all_words = sum(map(len, words))
    kinds = len({w for own in words for w in own})
    same = Counter(x.lower() for x in raw)
    found = []
    for x, own in zip(raw, words):
        n, k = len(x), max(len(own), 1)
        share = lambda chars, x=x, n=n: sum(x.count(bytes([c])) for c in chars) / n
        found.append([
            float(np.log1p(n)), float(np.log1p(k)), n / k, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"abcdefghijklmnopqrstuvwxyz"), share(b"0123456789"), share(b".,;:?'\"()-"),
            share(b"!*$%#&|<>{}[]=+\\/@^~_`"), share(b" \t\n\x0b\x0c\r"), sum(a == b for a, b in zip(own, own[1:])) / k, len(set(own)) / k, float(same[x.lower()]),
            kinds / max(all_words, 1), float(np.log1p(all_words)), float(x[-1:] in [bytes([c]) for c in b".,;:?'\"()-"]), float(65 <= x[0] <= 90),
        ])
    return found, [len(x) for x in raw]


def quality(docs, labels, parts=8):
    """doc -> score of every (doc_id, text)."""
    rows, prior = sample(docs, labels, 3, 1)
    read = [lines_of(t) for t, _ in rows]
    table = np.array([x for found, _ in read for x in found])
    cuts = [[float(np.quantile(table[:, j], k / parts)) for k in range(1, parts)] for j in range(table.shape[1])]

    def used(found):
        part = [[sum(c <= v for c in cuts[j]) for j, v in enumerate(x)] for x in found]
        edge = [parts] * len(cuts)
        return [[(side, j, v) for side, own in enumerate((part[i], part[i - 1] if i else edge, part[i + 1] if i + 1 < len(part) else edge)) for j, v in enumerate(own)] for i in range(len(part))]

    weigh = [[n / sum(sizes) for n in sizes] for _, sizes in read]
    total, n = sum(map(sum, weigh)), sum(map(len, weigh))
    weigh = [[w * n / total for w in own] for own in weigh]
    chain = Chain(0.0)
    chain.fit([used(found) for found, _ in read], [[y] * len(found) for (_, y), (found, _) in zip(rows, read)], weigh, 120, 0.2, 1e-4)

    def odds(found, sizes):
        if not found:
            return 0.0
        p, _ = chain.marginals(used(found))
        mean = min(max(sum(a * b for a, b in zip(p, sizes)) / sum(sizes), 1e-6), 1 - 1e-6)
        return math.log(mean / (1 - mean))

    scale = calibrated([[odds(*x), 1.0] for x in read], [y for _, y in rows], prior, 1e-3)
    return [sigmoid(scale[0] * odds(*lines_of(t)) + scale[1]) for _, t in docs]


# --- toxicity -----------------------------------------------------------------------

def words_of(text):
    """The forms of each word: itself, and its beginnings of 4, 5 and 6 bytes."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return [[(0, w), *((n, w[:n]) for n in (4, 5, 6) if len(w) >= n)] for w in words]


def toxicity(docs, labels):
    rows, prior = sample(docs, labels, 4, 2)
    read = [(words_of(t), y) for t, y in rows]
    bad, good = sum(y for _, y in read), sum(1 - y for _, y in read)
    counts = Counter((f, y) for own, y in read for f in {f for fs in own for f in fs})
    tied = set()
    for f in {f for f, _ in counts}:
        a, b = counts[f, 1], counts[f, 0]
        share = (a + b) / (bad + good)
        ratio = 2 * ((a * math.log(a / (bad * share)) if a else 0) + (b * math.log(b / (good * share)) if b else 0))
        if ratio > 20 and a / bad > 0.9 * (a / bad + b / good):
            tied.add(f)
    marks = [[int(y == 1 and any(f in tied for f in fs)) for fs in own] for own, y in read]
    chain = Chain(-6.0)
    chain.fit([own for own, _ in read], marks, [[1.0] * len(own) for own, _ in read], 40, 0.5, 1e-7)

    def evidence(own):
        p = chain.marginals(own)[0] if own else []
        none = min(sum(math.log1p(-min(v, 1 - 1e-12)) for v in p), -1e-13)
        most = min(max([*p, 1e-13]), 1 - 1e-13)
        bound = lambda v: max(-30.0, min(30.0, v))
        return [bound(math.log(most / (1 - most))), bound(math.log(-math.expm1(none)) - none), 1.0]

    scale = calibrated([evidence(own) for own, _ in read], [y for _, y in read], prior, 0.1)
    return [sigmoid(float(np.dot(evidence(words_of(t)), scale))) for _, t in docs]
