"""Hard negatives by a vector-approximation file.

Vectors are packed into blocks.  In a block each dimension is quantised into cells of about equally many values, and a vector is
approximated by its cells.  For an anchor, a table of each dimension's cells holds the least and the greatest
product that a value in the cell can give; sums of table lookups bound every score from below and from above.
A block's vectors are scored exactly only where the bounds leave them a place: among an anchor's
best positives, or among the first negatives of a positive's window.

Anchors are packed into slots, and every slot meets every block, both of bounded size.  Each meeting gives the best
few rows of each anchor, which are then ranked over all blocks.  Nothing is left out, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Anchors are the rows whose id this divides; rows whose id RELABEL divides get the next label of LABELS.
EVERY, RELABEL, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies within these percents of the positive's.
LEAST, MOST = 50, 95
#: Rows of a block, anchors of a slot, cells of a dimension, anchors that are bounded at once.
BLOCK, SLOT, CELLS, TILE = 8192, 2048, 64, 64
#: Bytes of all slots up to which they are broadcast; beyond, blocks and slots are shuffled, BLOCKS_A_KEY blocks to a key.
BROADCAST_BYTES, BLOCKS_A_KEY = 64 << 20, 64
_PAIRS = 1 << 15  # vectors scored exactly at once


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, label and v (integer components) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    rows = table.filter(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % RELABEL == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("v"),
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def _rows(batch: pa.RecordBatch, dims: int, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(2)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((batch.num_rows, dims), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), out


def approximated(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors (a row each) the cells by dimension, and each cell's least and greatest value."""
    n, dims = x.shape
    cell = np.zeros((dims, n), np.uint8)
    low, high = np.zeros((dims, cells), x.dtype), np.zeros((dims, cells), x.dtype)
    at = (np.arange(1, cells) * n) // cells
    for d in range(dims):
        values = np.sort(x[:, d])
        cuts = np.unique(values[at])  # a cut begins a cell
        cell[d] = np.searchsorted(cuts, x[:, d], "right")
        first = np.searchsorted(values, cuts)
        edges = np.concatenate([[0], first, [n]])
        for c in np.flatnonzero(np.diff(edges)):
            low[d, c], high[d, c] = values[edges[c]], values[edges[c + 1] - 1]
    return cell, low, high


def bounds(q: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors ``q`` (a row each) with a block's vectors, by table lookup.
    All arrays are of the type that the sums need."""
    least, most = (np.zeros((len(q), cell.shape[1]), q.dtype) for _ in range(2))
    for d in range(q.shape[1]):
        a, b = q[:, d, None] * low[d], q[:, d, None] * high[d]
        least += np.minimum(a, b).take(cell[d], axis=1)
        most += np.maximum(a, b).take(cell[d], axis=1)
    return least, most


def exact_scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), _PAIRS):
        out[k:k + _PAIRS] = np.einsum("ij,ij->i", q[i[k:k + _PAIRS]].astype(np.int64), x[j[k:k + _PAIRS]].astype(np.int64))
    return out


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each group's first ``k`` by score from the top, then by id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool), np.arange(len(g)), 0))
    return order[np.arange(len(g)) - start < k]


class _Block:
    """A packed block of vectors, ordered by label."""

    def __init__(self, row: dict, dims: int, dtype: type, wide: type, cells: int) -> None:
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["x"], dtype).reshape(-1, dims)
        self.cell = np.frombuffer(row["cell"], np.uint8).reshape(dims, -1)
        self.low, self.high = (np.frombuffer(row[k], dtype).reshape(dims, cells).astype(wide) for k in ("low", "high"))


class _Slot:
    def __init__(self, row: dict, dims: int, dtype: type, wide: type) -> None:
        self.ids, self.labels = np.frombuffer(row["anchors"], np.int64), np.frombuffer(row["anchor_labels"], np.int64)
        self.x = np.frombuffer(row["anchor_x"], dtype).reshape(-1, dims)
        self.wide = self.x.astype(wide)


def block_positives(s: _Slot, b: _Block, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors' indexes in the slot, ids and scores of the first ``k`` rows of their label in the block."""
    for label in np.unique(s.labels):
        a0, a1 = np.searchsorted(s.labels, [label, label + 1])
        c0, c1 = np.searchsorted(b.labels, [label, label + 1])
        if c0 == c1:
            continue
        for t in range(a0, a1, TILE):
            u = min(t + TILE, a1)
            least, most = bounds(s.wide[t:u], b.cell[:, c0:c1], b.low, b.high)
            other = b.ids[None, c0:c1] != s.ids[t:u, None]
            if c1 - c0 > k + 1:  # one of them may be the anchor itself
                floor = np.iinfo(least.dtype).min
                other &= most >= -np.partition(-np.where(other, least, floor + 1), k - 1, axis=1)[:, k - 1:k]
            i, j = np.nonzero(other)
            score = exact_scores(s.x, b.x, i + t, j + c0)
            best = _first(i, score, b.ids[j + c0], k)
            yield i[best] + t, b.ids[j[best] + c0], score[best]


def block_negatives(s: _Slot, b: _Block, wanted: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Of every anchor and each (positive id, score) of ``wanted``: the ids and scores of the first ``k`` rows of
    other labels in the block whose score lies in the window."""
    for t in range(0, len(s.ids), TILE):
        tile = [i for i in range(t, min(t + TILE, len(s.ids))) if wanted[i]]
        if not tile:
            continue
        least, most = bounds(s.wide[tile], b.cell, b.low, b.high)
        for row, i in enumerate(tile):
            low, high = least[row], most[row]
            c0, c1 = np.searchsorted(b.labels, [s.labels[i], s.labels[i] + 1])
            exact: dict[int, int] = {}
            for positive, score in wanted[i]:
                a, z = -(-LEAST * score // 100), MOST * score // 100
                may = (high >= a) & (low <= z)
                may[c0:c1] = False
                sure = low[may & (low >= a) & (high <= z)]
                if len(sure) >= k:
                    may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                at = np.flatnonzero(may)
                new = np.array([j for j in at.tolist() if j not in exact], np.int64)
                exact.update(zip(new.tolist(), exact_scores(s.x, b.x, np.full(len(new), i), new).tolist()))
                scores = np.array([exact[j] for j in at.tolist()], np.int64)
                inside = (scores >= a) & (scores <= z)
                at, scores = at[inside], scores[inside]
                best = np.lexsort((b.ids[at], -scores))[:k]
                yield i, positive, score, b.ids[at[best]], scores[best]


def _packed(rows: DataFrame, kind: str, dims: int, dtype: type, size: int, cells: int) -> DataFrame:
    """Rows of vec_id, label and v as blocks of up to ``size`` rows, or as one slot a partition."""
    block = kind == "block"
    names = ["at", "ids", "labels", "x", "cell", "low", "high"] if block else ["slot", "anchors", "anchor_labels", "anchor_x"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        kept: list[tuple[np.ndarray, ...]] = []

        def full(parts: list[tuple[np.ndarray, ...]]) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
            ids, labels, x = (np.concatenate(a) for a in zip(*parts))
            take = len(ids) if not block else min(size, len(ids))
            rest = ids[take:], labels[take:], x[take:]
            order = np.lexsort((ids[:take], labels[:take]))
            ids, labels, x = ids[:take][order], labels[:take][order], x[:take][order]
            columns = [pa.array([part + (n << 32) if block else part], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, labels, x, *(approximated(x, cells) if block else ())))]
            return pa.RecordBatch.from_arrays(columns, names), rest

        for batch in batches:
            if batch.num_rows:
                kept.append(_rows(batch, dims, dtype))
            while block and sum(len(a[0]) for a in kept) >= size:
                out, rest = full(kept)
                kept, n = [rest], n + 1
                yield out
        if sum(len(a[0]) for a in kept):
            yield full(kept)[0]

    return rows.select("vec_id", "label", "v").mapInArrow(pack, f"{names[0]} long, " + ", ".join(f"{c} binary" for c in names[1:]))


def _met(blocks: DataFrame, slots: DataFrame, n_slots: int, n_blocks: int, small: bool) -> DataFrame:
    """Every block beside every slot."""
    if small:
        return blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slots - 1).cast("long")))).join(F.broadcast(slots), "slot")
    keys = -(-n_blocks // BLOCKS_A_KEY)
    key: Column = F.pmod(F.xxhash64("at"), F.lit(keys))
    dealt = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slots - 1).cast("long")))).withColumn("key", key)
    return dealt.join(slots.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long")))), ["slot", "key"])


def hard_negatives(table: DataFrame, block: int = BLOCK, slot: int = SLOT, cells: int = CELLS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``table`` (vec_id, embedding, label).

    Rows without an id, a label or a vector, or with a component that is null or not finite, take no part.  Of rows
    that repeat a vec_id one counts, the one of the smallest label, then the smallest vector; so no id is its own positive.
    Shorter vectors count as filled up with zeros.  A positive without a row in its window, as every one of a negative
    score, gives no rows; an empty table gives none; further columns are ignored.  Components whose scores could
    exceed 62 bits are an error.  ``cells`` (2 to 256) changes the work, not the result."""
    spark = table.sparkSession
    rows = vectors(table)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    shape = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count_if(F.col("vec_id") % EVERY == 0)).first()
    n, dims, top, n_anchors = shape[0], max(shape[1] or 0, 1), max(shape[2] or 0, 1), shape[3]
    if not n_anchors:
        return spark.createDataFrame([], schema)
    if dims * top * top >= 1 << 62:
        raise ValueError(f"components of up to {top} in {dims} dimensions: scores don't fit 62 bits")
    dtype = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    wide = np.int32 if dims * top * top < 1 << 31 else np.int64
    blocks = written(_packed(rows.coalesce(-(-n // block)), "block", dims, dtype, block, cells), "blocks")
    n_blocks = blocks.count()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                at = np.flatnonzero(ids % EVERY == 0)
                x = np.frombuffer(row["x"], dtype).reshape(-1, dims)[at].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.frombuffer(row["labels"], np.int64)[at]), pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * dims, pa.array(x.reshape(-1)))], ["vec_id", "label", "v"])

    n_slots = -(-n_anchors // slot)
    picked = blocks.select("ids", "labels", "x").mapInArrow(anchors, "vec_id long, label long, v array<long>")
    slots = written(_packed(picked.repartition(n_slots), "slot", dims, dtype, slot, cells), "slots")
    small = n_anchors * (dims * np.dtype(dtype).itemsize + 16) <= broadcast_bytes

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                s, b = _Slot(row, dims, dtype, wide), _Block(row, dims, dtype, wide, cells)
                for at, ids, scores in block_positives(s, b, POSITIVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["slot"])), pa.array(s.ids[at]), pa.array(ids), pa.array(scores)], ["slot", "anchor_id", "positive_id", "positive_score"])

    met = _met(blocks, slots, n_slots, n_blocks, small)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = (
        met.mapInArrow(near, "slot long, anchor_id long, positive_id long, positive_score long")
        .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= POSITIVES)
        .groupBy("slot").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("wanted"))
    )
    sought = written(slots.join(positives, "slot"), "sought")

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                s, b = _Slot(row, dims, dtype, wide), _Block(row, dims, dtype, wide, cells)
                place = {v: i for i, v in enumerate(s.ids.tolist())}
                wanted: list[list[tuple[int, int]]] = [[] for _ in s.ids]
                for w in row["wanted"]:
                    if w["positive_score"] >= 0:
                        wanted[place[w["anchor_id"]]].append((w["positive_id"], w["positive_score"]))
                found = [(s.ids[i], p, score, ids, scores) for i, p, score, ids, scores in block_negatives(s, b, wanted, NEGATIVES) if len(ids)]
                if found:
                    sizes = [len(f[3]) for f in found]
                    columns = [np.repeat(np.array([f[c] for f in found], np.int64), sizes) for c in range(3)] + [np.concatenate([f[c] for f in found]) for c in (3, 4)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        _met(blocks, sought, n_slots, n_blocks, small)
        .mapInArrow(hard, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= NEGATIVES)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
