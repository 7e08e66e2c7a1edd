"""Toxic spans by a linear-chain CRF over words.

Labels say which documents are toxic, not which words: the words of toxic training documents whose
form or beginning is tied to them (a likelihood-ratio test over documents) are labelled toxic,
all other words clean, and a CRF is trained on these chains.  Its forward-backward marginals give
each word a probability; a document's score is the calibrated chance that any word is toxic, and
runs of words above one half are its offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import crf

#: Labelled documents of each class, at most (about), that the model is fitted on, and the characters of a longer one that are learned from.
TRAIN_DOCS = 1_500
TRAIN_CHARS = 40_000
#: Lengths in bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
#: Forms with weights of their own beside those tied to toxic documents: the ones in most documents.
COMMON_FORMS = 4_000
#: Documents of each class, by a hash of doc_id, that the field's weights are fitted on, besides one for each tied form that
#: those lack; which forms are tied to toxic ones is told by all of the sample.
FIT_DOCS = 600
#: Slots of the table that narrows down where a form is, as a power of two.
SLOT_BITS = 18
#: Rows up to which the labels of the sample are broadcast.
BROADCAST_ROWS = 500_000
#: Likelihood ratio from which a form counts as tied to toxic documents, and the share of its documents that are toxic.
TIED = 20.0
PURE = 0.9
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3


@dataclass
class Model:
    """Forms by their 64-bit hashes; a form's weight is the one after its place, the bias is first."""

    forms: np.ndarray
    weights: np.ndarray
    chain: crf.Chain
    scale: np.ndarray  # of what evidence() gives

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The forms in order, their places counted from 1, and where each slot's forms begin."""
        order = np.argsort(self.forms)
        known = self.forms[order]
        slots = np.searchsorted(known >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        return known, order + 1, slots


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words' starts and ends, rows' bounds in them, and the hashes of each word's forms: itself and its beginnings (0 if it is shorter)."""
    starts, ends, firsts = C.word_spans(data, bounds, C.WORD_BYTES)
    sums = C.prefix_sums(data)
    forms = [C.span_hashes(sums, starts, ends)]
    for n in BEGINNINGS:
        h = C.mixed(C.span_hashes(sums, starts, np.minimum(starts + n, ends)) ^ np.uint64(n))
        forms.append(np.where(ends - starts >= n, h, np.uint64(0)))
    return starts, ends, firsts, forms


def places(forms: list[np.ndarray], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Each form's place among the known ones, counted from 1; 0 if it isn't known."""
    known, place, slots = table
    found = []
    for h in forms:
        out = np.zeros(len(h), np.int64)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, end = slots[slot], slots[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            i = at[left]
            hit = known[i] == h[left]
            out[left[hit]] = place[i[hit]]
            at[left] += 1
            left = left[~hit & (i + 1 < end[left])]
        found.append(out)
    return found


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' bytes in lower case and their bounds, some at a time."""
    for _, data, bounds in C.chunks([pa.RecordBatch.from_arrays([pc.utf8_lower(texts)], ["text"])]):
        yield data, bounds


def without_copies(texts: pa.Array) -> np.ndarray:
    """Of each row, whether at most half of its lines stand in rows before it.  Copies of a toxic text would
    else tie all of its words to toxic documents."""
    h, size, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for data, bounds in _pieces(texts):
        starts, ends, firsts = C.word_spans(data, bounds, ~C.class_table(b"\n.", False))
        h.append(C.span_hashes(C.prefix_sums(data), starts, ends))
        size.append(ends - starts)
        counts.append(np.diff(firsts))
    h, size, counts = np.concatenate(h), np.concatenate(size), np.concatenate(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    old = row[first][back] < row
    return np.bincount(row, old * size, len(counts)) / np.maximum(np.bincount(row, size, len(counts)), 1) <= 0.5


def all_features(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows' bounds in all words, and the words' forms."""
    firsts, forms = [np.zeros(1, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(1 + len(BEGINNINGS))]
    for data, bounds in _pieces(texts):
        _, _, own, found = features(data, bounds)
        firsts.append(own[1:] + firsts[-1][-1])
        for all_, x in zip(forms, found):
            all_.append(x)
    return np.concatenate(firsts), [np.concatenate(x) for x in forms]


def tied_forms(forms: list[np.ndarray], firsts: np.ndarray, toxic: np.ndarray, common_forms: int | None = COMMON_FORMS) -> tuple[np.ndarray, np.ndarray]:
    """The forms tied to toxic documents, by the numbers of documents that have them, and the most common ones of all (or all others)."""
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    bad, good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    tied, common = [np.zeros(0, np.uint64)], []
    for own in forms:
        order = np.lexsort((row, own))
        h, r = own[order], row[order]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) & (h > 0)
        h, r = h[once], r[once]
        values, back = np.unique(h, return_inverse=True)
        a, b = np.bincount(back, toxic[r], len(values)), np.bincount(back, ~toxic[r], len(values))
        share = (a + b) / (bad + good)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(a > 0, a * np.log(a / (bad * share)), 0) + np.where(b > 0, b * np.log(b / (good * share)), 0))
        chosen = (ratio > TIED) & (a / bad > PURE * (a / bad + b / good))
        tied.append(values[chosen])
        common.append((a + b, values))
    counts, values = (np.concatenate([c[i] for c in common]) for i in (0, 1))
    tied_all = np.concatenate(tied)
    top = values[np.argsort(-counts, kind="stable")[:common_forms]]
    return tied_all, top[~np.isin(top, tied_all)]


def evidence(p: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Of each row the log odds of its likeliest word, those that any word is toxic were they independent
    (none beyond MOST from zero), and 1."""
    gone = np.log1p(-np.minimum(p, 1 - 1e-12))
    sums = np.concatenate([[0.0], np.cumsum(gone)])
    none = np.minimum(sums[firsts[1:]] - sums[firsts[:-1]], -1e-13)  # log of the chance that none is
    most = np.full(len(firsts) - 1, 1e-13)
    full = np.flatnonzero(np.diff(firsts))
    if len(full):
        most[full] = np.clip(np.maximum.reduceat(p, firsts[:-1][full]), 1e-13, 1 - 1e-13)
    return np.column_stack([np.clip(np.log(most / (1 - most)), -crf.MOST, crf.MOST), np.clip(np.log(-np.expm1(none)) - none, -crf.MOST, crf.MOST), np.ones(len(none))])


def train(texts: pa.Array, toxic: np.ndarray, prior: float, common_forms: int | None = COMMON_FORMS) -> Model:
    """``texts`` in the order in which they are preferred.  ``prior``: the share of toxic documents among all labelled ones, to which scores are calibrated."""
    level = np.log(prior / (1 - prior)) if 0 < prior < 1 else (10.0 if prior else -10.0)
    none = Model(np.zeros(0, np.uint64), np.zeros(1), crf.Chain(), np.array([0.0, 0.0, level]))
    if not len(toxic):
        return none
    single = without_copies(texts)
    texts, toxic = texts.filter(pa.array(single)), toxic[single]
    if toxic.all() or not toxic.any():
        return none
    firsts, forms = all_features(texts)
    tied, common = tied_forms(forms, firsts, toxic, common_forms)
    model = Model(np.concatenate([tied, common]), np.zeros(1), crf.Chain(), np.array([0.0, 0.0, level]))
    fit = np.zeros(len(toxic), bool)
    for y in (toxic, ~toxic):
        fit[np.flatnonzero(y)[:FIT_DOCS]] = True
    row = np.repeat(np.arange(len(toxic)), np.diff(firsts))
    for h in forms:
        on = np.flatnonzero(np.isin(h, tied) & toxic[row])
        on = on[~np.isin(h[on], h[on[fit[row[on]]]])]
        fit[row[on[np.unique(h[on], return_index=True)[1]]]] = True
    firsts, forms = all_features(texts.filter(pa.array(fit)))
    toxic = toxic[fit]
    at = places(forms, model.table())
    row = np.repeat(np.arange(len(toxic)), np.diff(firsts))
    labels = (np.logical_or.reduce([(x > 0) & (x <= len(tied)) for x in at]) & toxic[row]).astype(np.int64)
    size = 1 + len(model.forms)

    def gather(w: np.ndarray) -> np.ndarray:
        padded = np.concatenate([[0.0], w[1:]])
        return w[0] + sum(padded[x] for x in at)

    def spread(e: np.ndarray) -> np.ndarray:
        slope = sum(np.bincount(x, e, size) for x in at)
        slope[0] = e.sum()
        return slope

    model.weights, model.chain = crf.fit(gather, spread, size, labels, firsts, rounds=40, rate=0.5, decay=1e-7, bias=-6.0)
    p, _ = crf.marginals(gather(model.weights), firsts, model.chain)
    share = toxic.mean()
    weigh = np.where(toxic, prior / share, (1 - prior) / (1 - share))
    model.scale = crf.logistic(evidence(p, firsts), toxic.astype(float), weigh, ridge=0.1)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, column: str, per_class: int, longest: int) -> tuple[pa.Table, float]:
    """About ``per_class`` labelled rows of each class that aren't held out, chosen by a hash of doc_id (text, y, drawn) and in its
    order, and the share of class 1 among all of them.  Of a document with several labels the largest counts; of a
    text longer than ``longest`` characters a piece of that length, by another hash."""
    known = labels.filter(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("y"))
    known = known.filter(~held_out)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 24))
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (drawn < int(min(1.0, per_class / n) * (1 << 24))))
    chosen = C.written(known.filter(keep), "labelled")
    rows = docs.select("doc_id", "text").join(C.sized(chosen, chosen.count(), BROADCAST_ROWS), "doc_id").filter(F.col("text").isNotNull())
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(F.lit(1), F.length("text") - longest + 1)).cast("int")
    table = rows.select(F.substr("text", start, F.lit(longest)).alias("text"), F.col("y").cast("int").alias("y"), drawn.alias("drawn")).toArrow()
    return table.sort_by([("drawn", "ascending"), ("text", "ascending")]).combine_chunks(), counts.get(1, 0) / max(1, sum(counts.values()))


def held_out_rows(n: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == remainder, F.lit(False))


def toxic_spans(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, common_forms: int | None = COMMON_FORMS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, n_words, spans (start, end in code
    points, probability), the runs of words that are likelier toxic than not.

    Learns from labels.toxic of rows whose crc32 of doc_id modulo 4 isn't 2.  Null and empty texts
    have no words and get the score of a document without toxic words; without labels of both
    classes all scores are the labelled share of toxic documents.  Null labels are not learned
    from.  Repeated rows are judged each for itself; further columns are ignored.  Without ``common_forms`` every
    form of the learning rows, whose number ``TRAIN_DOCS`` bounds, has a weight."""
    held_out = held_out_rows(4, 2)
    table, prior = training_rows(docs, labels, held_out, "toxic", per_class, TRAIN_CHARS)
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    model = train(texts, table.column("y").to_numpy() == 1, prior, common_forms)
    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        table, weights = m.table(), np.concatenate([[0.0], m.weights[1:]]).astype(np.float32)
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for rows, data, bounds in C.chunks([whole.set_column(at, "text", pc.utf8_lower(whole.column(at)))]):
                starts, ends, firsts, forms = features(data, bounds)
                scores = np.full(len(starts), m.weights[0], np.float32)
                for x in places(forms, table):
                    scores += weights[x]
                p, _ = crf.marginals(scores, firsts, m.chain)
                z = evidence(p, firsts) @ m.scale
                spans: list[list] = [[] for _ in range(rows.num_rows)]
                on = np.flatnonzero(p > 0.5)
                owner = np.searchsorted(firsts, on, "right") - 1
                new = np.flatnonzero(np.concatenate([[True], (np.diff(on) > 1) | (np.diff(owner) > 0)])) if len(on) else []
                for k, a in enumerate(new):
                    b = (new[k + 1] if k + 1 < len(new) else len(on)) - 1
                    i = int(owner[a])
                    head = data[bounds[i]:ends[on[b]]]
                    points = np.count_nonzero((head[: starts[on[a]] - bounds[i]] & 0xC0) != 0x80)
                    spans[i].append({"start": points, "end": int(np.count_nonzero((head & 0xC0) != 0x80)), "probability": float(p[on[a:b + 1]].max())})
                yield pa.record_batch({
                    "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "score": pa.array(1 / (1 + np.exp(-z))),
                    "n_words": pa.array(np.diff(firsts).astype(np.int64)), "spans": pa.array(spans, pa.list_(span)),
                })

    return docs.mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, n_words long, spans array<struct<start:int,end:int,probability:double>>")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The digest of :func:`toxic_spans`: doc_id, held_out, score, predicted, n_spans, spans as text."""
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return toxic_spans(docs, labels).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"), told.alias("spans"),
    )
