"""Document quality by a linear-chain CRF over lines.

Every line is labelled good or bad.  A line's features tell its make-up (case, digits, marks, word
lengths, repetition within it and among the document's lines) and that of its neighbours; in
training all lines of a document have the document's label.  Forward-backward marginals, weighted
by the lines' lengths, add up to the document's quality, which is then calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import crf
from .toxicity import held_out_rows, training_rows

#: Labelled documents of each class, at most (about), that the model is fitted on, and the characters of a longer one that are learned from.
TRAIN_DOCS = 800
TRAIN_CHARS = 40_000
THRESHOLD = 0.5
#: Ways to cut a feature's range; each part is a weight of its own.
PARTS = 8

_LINE_BYTES = ~C.class_table(b"\n\r", False)
_UPPER = C.class_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", False)
_LOWER = C.class_table(b"abcdefghijklmnopqrstuvwxyz", False)
_DIGIT = C.class_table(b"0123456789", False)
_STOPS = C.class_table(b".,;:?'\"()-", False)
_MARKS = C.class_table(b"!*$%#&|<>{}[]=+\\/@^~_`", False)
_SPACE = ~C.SOLID_BYTES


@dataclass
class Model:
    cuts: np.ndarray  # of each feature's range, PARTS - 1 of them
    weights: np.ndarray
    chain: crf.Chain
    scale: np.ndarray


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of numbers for each line (a run of bytes other than line ends), the lines' lengths, and the rows' bounds in the lines."""
    starts, ends, firsts = C.word_spans(data, bounds, _LINE_BYTES)
    n = len(starts)
    size = (ends - starts).astype(np.float64)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (sums[ends] - sums[starts]) / size

    low = C.lowered(data)
    w0, w1, of = C.word_spans(low, np.concatenate([starts, ends[-1:]]) if n else np.zeros(1, np.int64), C.SOLID_BYTES & _LINE_BYTES)
    words = np.maximum(np.diff(of), 1).astype(np.float64) if n else np.zeros(0)
    line = np.repeat(np.arange(n), np.diff(of)) if n else np.zeros(0, np.int64)
    sums = C.prefix_sums(low)
    h = C.span_hashes(sums, w0, w1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    row = np.searchsorted(firsts, np.arange(n), "right") - 1
    order = np.lexsort((h, line))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    kinds = np.bincount(line[order][first], minlength=n)[:n]
    doc_words = row[line]
    by_doc = np.lexsort((h, doc_words))
    opening = np.ones(len(h), bool)
    opening[1:] = (h[by_doc][1:] != h[by_doc][:-1]) | (doc_words[by_doc][1:] != doc_words[by_doc][:-1])
    per_doc = np.bincount(doc_words[by_doc][opening], minlength=len(bounds) - 1)
    all_words = np.bincount(doc_words, minlength=len(bounds) - 1)
    whole = C.span_hashes(sums, starts, ends)
    key = C.mixed(whole ^ C.mixed(row.astype(np.uint64)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    last = data[ends - 1] if n else np.zeros(0, np.uint8)
    found = np.column_stack([
        np.log1p(size), np.log1p(words), size / words, share(_UPPER), share(_LOWER), share(_DIGIT), share(_STOPS), share(_MARKS), share(_SPACE),
        np.bincount(line[again], minlength=n)[:n] / words, kinds / words, count[back].astype(np.float64),
        per_doc[row] / np.maximum(all_words[row], 1), np.log1p(all_words[row]), _STOPS[last].astype(np.float64), _UPPER[data[starts]].astype(np.float64) if n else np.zeros(0),
    ])
    return found, size, firsts


def slots(found: np.ndarray, cuts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each line the weights that apply: one of each feature of it, of the line before and of the line after."""
    n, k = found.shape
    part = np.empty((n, k), np.int32)
    for j in range(k):
        part[:, j] = np.searchsorted(cuts[j], found[:, j], "right") + j * (PARTS + 1)
    outside = np.broadcast_to(PARTS + np.arange(k, dtype=np.int32) * (PARTS + 1), (n, k))
    before, after = outside.copy(), outside.copy()
    if n > 1:
        heads = np.zeros(n + 1, bool)
        heads[firsts] = True
        inner = ~heads[1:n]
        before[1:][inner] = part[:-1][inner]
        after[:-1][inner] = part[1:][inner]
    step = k * (PARTS + 1)
    return np.concatenate([part, before + step, after + 2 * step], axis=1) + 1


def weighted(p: np.ndarray, size: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The length-weighted mean of a row's marginals, as log odds; zero without lines."""
    sums, lengths = (np.concatenate([[0.0], np.cumsum(x)]) for x in (p * size, size))
    total = lengths[firsts[1:]] - lengths[firsts[:-1]]
    mean = np.where(total > 0, (sums[firsts[1:]] - sums[firsts[:-1]]) / np.maximum(total, 1), 0.5)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def train(texts: pa.Array, good: np.ndarray, prior: float) -> Model:
    """``prior``: the share of good documents among all labelled ones, to which scores are calibrated."""
    kinds = line_features(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].shape[1]
    size = 1 + 3 * kinds * (PARTS + 1)
    if not len(good) or good.all() or not good.any():
        return Model(np.zeros((kinds, PARTS - 1)), np.zeros(size), crf.Chain(), np.array([0.0, np.log(prior / (1 - prior)) if 0 < prior < 1 else (10.0 if prior else -10.0)]))
    parts = [line_features(data, bounds) for _, data, bounds in C.chunks([pa.RecordBatch.from_arrays([texts], ["text"])])]
    found, lengths = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    firsts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in parts]))])
    cuts = np.quantile(found, np.arange(1, PARTS) / PARTS, axis=0).T
    used = np.asfortranarray(slots(found, cuts, firsts))
    row = np.repeat(np.arange(len(good)), np.diff(firsts))
    labels = good[row].astype(np.int64)
    # Each document counts alike, and each line by its share of it.
    weigh = lengths / np.maximum(np.bincount(row, lengths, len(good))[row], 1)
    weigh *= len(weigh) / weigh.sum()

    def gather(w: np.ndarray) -> np.ndarray:
        return w[0] + sum(w[own] for own in used.T)

    def spread(e: np.ndarray) -> np.ndarray:
        slope = sum(np.bincount(own, e, size) for own in used.T)
        slope[0] = e.sum()
        return slope

    weights, chain = crf.fit(gather, spread, size, labels, firsts, rounds=120, rate=0.2, weigh=weigh)
    p, _ = crf.marginals(gather(weights), firsts, chain)
    odds = weighted(p, lengths, firsts)
    share = good.mean()
    balance = np.where(good, prior / share, (1 - prior) / (1 - share))
    return Model(cuts, weights, chain, crf.logistic(np.column_stack([odds, np.ones(len(odds))]), good.astype(float), balance))


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS):
    """The model, broadcast."""
    table, prior = training_rows(docs, labels, held_out_rows(3, 1), "quality", per_class, TRAIN_CHARS)
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    return docs.sparkSession.sparkContext.broadcast(train(texts, table.column("y").to_numpy() == 1, prior))


def scores(m: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' scores, their lines' marginals, and the rows' bounds in the lines."""
    found, size, firsts = line_features(data, bounds)
    p, _ = crf.marginals(m.weights[0] + m.weights[slots(found, m.cuts, firsts)].sum(axis=1), firsts, m.chain)
    return 1 / (1 + np.exp(-(m.scale[0] * weighted(p, size, firsts) + m.scale[1]))), p, firsts


def line_quality(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, n_lines, lines (the probability of
    good for each line that isn't empty).

    Learns from labels.quality of rows whose crc32 of doc_id modulo 3 isn't 1.  Null and empty texts
    have no lines and get the score of even odds, calibrated; without labels of both classes all
    scores are the labelled share of good documents.  Null labels are not learned from.  Repeated
    rows are judged each for itself; further columns are ignored."""
    held_out = held_out_rows(3, 1)
    known = fitted(docs, labels, per_class)
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for rows, data, bounds in C.chunks(batches):
            score, p, firsts = scores(m, data, bounds)
            yield pa.record_batch({
                "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "score": pa.array(score),
                "n_lines": pa.array(np.diff(firsts).astype(np.int64)), "lines": pa.ListArray.from_arrays(firsts.astype(np.int32), pa.array(p)),
            })

    return docs.mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, n_lines long, lines array<double>")


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The digest of :func:`line_quality`: doc_id, held_out, score, predicted, n_lines, n_bad_lines."""
    return line_quality(docs, labels).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_lines", F.size(F.filter("lines", lambda p: p < 0.5)).cast("long").alias("n_bad_lines"),
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.  A row's own text decides, whatever its
    doc_id is and which others have it; null and empty texts score as in :func:`line_quality`."""
    known = fitted(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            yield rows.filter(pa.array(scores(known.value, data, bounds)[0] >= threshold))

    return docs.mapInArrow(judge, docs.schema)
