"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts is frozen after training: a context gives
the symbols seen in it their shares and keeps an escape share for the rest, which go by the next
shorter context without the symbols already ruled out (method C with exclusions).  The trees are
laid over one another as one automaton whose state is the longest context known, so a text's exact
code length under all languages is a walk with one table row a byte.  Walks start anew at any block
of a text after as many bytes as the longest context has, so all blocks are walked side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents of each language, at most (about), that statistics are fitted on.
TRAIN_DOCS = 1_500
#: Bytes of the longest context.
ORDER = 4
#: Contexts of all languages together, at most, in equal shares: of each language those that it sees most.  The automaton's tables
#: take 12 bytes for each state, symbol and language on the driver while they are made, and 4 in the tasks.
STATES = 24_000
#: Languages up to which their counts are broadcast.
BROADCAST_LANGUAGES = 10_000
BLOCK = 64


@dataclass
class Model:
    """classes: a byte's symbol; steps: the next state; bits: the code length under each language."""

    languages: list[str]
    classes: np.ndarray
    steps: np.ndarray
    bits: np.ndarray
    order: int


def folded(col: pa.Array) -> pa.Array:
    """Lower case, so that a text's case doesn't hide its language."""
    return pc.utf8_lower(col)


def training_rows(docs: DataFrame, held_out: Column, per_language: int = TRAIN_DOCS) -> DataFrame:
    """About ``per_language`` of the rows with a text and a lang that aren't held out, chosen by a hash of doc_id."""
    fit = docs.filter(~held_out & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)
    counts = C.written(counts, "languages")
    return fit.join(C.sized(counts, counts.count(), BROADCAST_LANGUAGES), "lang").filter(drawn).select("lang", "text")


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """How often each byte follows each context of 0 to ``order`` bytes in the texts of a lang: lang, gram
    (the bytes as a number), length, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                own = pa.RecordBatch.from_arrays([folded(batch.column("text").filter(pa.array(langs == lang)))], ["text"])
                for _, data, bounds in C.chunks([own]):
                    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                    gram = np.zeros(len(data), np.int64)
                    for k in range(order + 1):
                        # gram at i: bytes i to i + k, if they are of one row
                        gram = (gram[: len(data) - k] << 8) | data[k:].astype(np.int64) if k else data.astype(np.int64)
                        whole = gram[row[: len(gram)] == row[k:]]
                        values, counts = np.unique(whole, return_counts=True)
                        yield pa.record_batch({"lang": pa.array([lang] * len(values), pa.string()), "gram": pa.array(values), "length": pa.array(np.full(len(values), k + 1, np.int32)), "n": pa.array(counts.astype(np.int64))})

    return rows.mapInArrow(count, "lang string, gram long, length int, n long").groupBy("lang", "gram", "length").agg(F.sum("n").alias("n"))


def kept_grams(grams: DataFrame, states: int | None = STATES) -> DataFrame:
    """All grams, those seen once too, of the contexts that each language sees most; ``states`` contexts are shared out among the languages.
    Without ``states`` all contexts of the learning rows are kept, whose number ``TRAIN_DOCS`` bounds."""
    if states is None:
        return grams
    grams = C.written(grams, "grams")
    quota = max(1, states // max(1, grams.select("lang").distinct().count()))
    context = F.shiftright("gram", 8)
    seen = grams.filter("length > 1").groupBy("lang", context.alias("context"), "length").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "length", "context"))
    kept = seen.withColumn("rank", rank).filter(F.col("rank") <= quota).select("context", "length").distinct()
    longer = grams.withColumn("context", context).join(F.broadcast(kept), ["context", "length"], "left_semi").select(grams.columns)  # at most ``states`` rows
    return grams.filter("length = 1").unionByName(longer)


def build(grams: pa.Table, order: int = ORDER, states: int | None = None) -> Model:
    """The automaton of the trees that the grams span, or of the ``states`` most frequent of their contexts."""
    states = grams.num_rows if states is None else states
    languages = sorted(set(grams.column("lang").to_pylist()))
    lang = np.searchsorted(np.array(languages), np.array(grams.column("lang").to_pylist(), str)) if languages else np.zeros(0, np.int64)
    gram, length, n = (grams.column(c).to_numpy() for c in ("gram", "length", "n"))
    seen = np.unique(gram[length == 1])
    size = len(seen) + 1  # the last symbol stands for all bytes not seen
    classes = np.full(256, size - 1, np.int32)
    classes[seen] = np.arange(len(seen))

    # Contexts by length, the most frequent ones; each with its prefix and its suffix.
    context, symbol = gram >> 8, classes[(gram & 255).astype(np.int64)]
    kept: list[np.ndarray] = [np.zeros(1, np.int64)]
    totals: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, order + 1):
        own = length == k + 1
        values, back = np.unique(context[own], return_inverse=True)
        totals.append((values, np.bincount(back, n[own], len(values))))
    every = np.sort(np.concatenate([t for _, t in totals] + [np.zeros(0)]))[::-1]
    bar = every[min(states, len(every)) - 1] if len(every) else 0
    for k in range(1, order + 1):
        values, count = totals[k - 1]
        values = values[count > bar] if len(every) > states else values
        shorter = kept[-1]
        if k > 1:
            values = values[np.isin(values >> 8, shorter) & np.isin(values & ((1 << (8 * (k - 1))) - 1), shorter)]
        kept.append(values)
    first = np.concatenate([[0], np.cumsum([len(x) for x in kept])])

    def state_of(values: np.ndarray, k: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(kept[k], values), max(0, len(kept[k]) - 1))
        ok = (kept[k][at] == values) if len(kept[k]) else np.zeros(len(values), bool)
        return np.where(ok, first[k] + at, -1)

    share = np.full((int(first[-1]), size, len(languages)), 1 / 256, np.float32)
    share[:, size - 1] = (257 - size) / 256
    steps = np.zeros((int(first[-1]), size), np.int32)
    for k in range(order + 1):
        ids = np.arange(first[k], first[k + 1])
        suffix = state_of(kept[k] & ((1 << (8 * (k - 1))) - 1), k - 1) if k else np.zeros(0, np.int64)
        counts = np.zeros((len(ids), size, len(languages)), np.float32)
        own = length == k + 1
        at = state_of(context[own], k) if k else np.zeros(int(own.sum()), np.int64)
        ok = at >= 0
        np.add.at(counts, (at[ok] - first[k], symbol[own][ok], lang[own][ok]), n[own][ok])
        below = share[suffix] if k else share[:1].copy()
        distinct = (counts > 0).sum(axis=1, keepdims=True)
        total = counts.sum(axis=1, keepdims=True) + distinct
        rest = np.where(counts > 0, 0.0, below)
        escape = distinct / np.maximum(total, 1) * rest / rest.sum(axis=1, keepdims=True)
        share[ids] = np.where(distinct > 0, np.where(counts > 0, counts / np.maximum(total, 1), escape), below)
        # After a symbol: the context longer by it, if there is one, else where the suffix goes.
        steps[ids] = steps[suffix] if k else 0
        if k < order and len(kept[k + 1]):
            longer = kept[k + 1]
            steps[state_of(longer >> 8, k), classes[longer & 255]] = state_of(longer, k + 1)
    return Model(languages, classes, steps.reshape(-1), -np.log2(share).astype(np.float32).reshape(-1, max(1, len(languages))) if languages else np.zeros((0, 1), np.float32), order)


def code_lengths(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits of each row under each language."""
    lengths = np.diff(bounds)
    size = int(model.classes.max()) + 1
    blocks = (lengths + BLOCK - 1) // BLOCK
    row = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = bounds[:-1][row] + nth * BLOCK
    end = np.minimum(begin + BLOCK, bounds[1:][row])
    order = np.argsort(begin - end, kind="stable")
    begin, end, row = begin[order], end[order], row[order]
    symbols = model.classes[data]
    state = np.zeros(len(row), np.int64)
    for j in range(model.order, 0, -1):
        at = np.maximum(begin - j, bounds[:-1][row])
        state = np.where(begin - j >= bounds[:-1][row], model.steps[state * size + symbols[at]], 0) if len(row) else state
    sums = np.zeros((len(row), len(model.languages)), np.float32)
    active = np.searchsorted(begin - end, -np.arange(BLOCK), "left")
    for j in range(BLOCK):
        k = int(active[j])
        if not k:
            break
        at = state[:k] * size + symbols[begin[:k] + j]
        sums[:k] += model.bits[at]
        state[:k] = model.steps[at]
    found = np.zeros((len(lengths), len(model.languages)))
    for i in range(len(model.languages)):
        found[:, i] = np.bincount(row, sums[:, i], len(lengths))
    return found


def language_report(docs: DataFrame, per_language: int = TRAIN_DOCS, order: int = ORDER, states: int | None = STATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score (the share of the
    best language when code lengths turn back into probabilities), n_bits (its code length).

    Statistics come from text and lang of rows whose crc32 of doc_id modulo 3 isn't 1.  A null text,
    an empty one and one without letters is ``und`` with score 0; so is every text if no row can be
    learned from.  A null doc_id isn't held out.  Equal code lengths go to the first language by
    name.  Repeated rows are judged each for itself; further columns are ignored."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    grams = kept_grams(gram_counts(training_rows(docs, held_out, per_language), order), states)
    model = build(grams.toArrow(), order)
    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for whole in batches:
            at = whole.schema.get_field_index("text")
            batch = whole.set_column(at, "text", folded(whole.column(at)))
            for rows, data, bounds in C.chunks([batch]):
                letters = pc.fill_null(pc.match_substring_regex(rows.column(at), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if m.languages:
                    bits = code_lengths(m, data, bounds)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(bits)), best]
                    score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
                    names = np.array(m.languages, object)[best]
                else:
                    letters, least, score, names = np.zeros_like(letters), np.zeros(len(letters)), np.zeros(len(letters)), np.full(len(letters), "und", object)
                yield pa.record_batch({
                    "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "lang_pred": pa.array(np.where(letters, names, "und"), pa.string()),
                    "score": pa.array(np.where(letters, score, 0.0)), "n_bits": pa.array(np.where(letters, least, 0.0)),
                })

    return docs.mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_bits double")
