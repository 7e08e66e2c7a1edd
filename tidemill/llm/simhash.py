"""Near duplicates by SimHash fingerprints under a generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits.  If two fingerprints differ in at most
T bits, and thresholds t_i >= -1 of the m partitions add up to T - m + 1, then in some partition
with t_i >= 0 they differ in at most t_i bits.  Thresholds and m come from a dynamic program over
candidate counts that are estimated from a sample of the fingerprints.  Fingerprints that differ in
at most t bits of a partition share a key made by clearing some t of its bits; those that share a
key are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components, contract

WORDS = 3
SEED = 42
DISTANCE = 3
#: Fingerprints (not documents) from which candidate counts are estimated.
SAMPLE = 20_000
#: Fingerprints with one key that are compared in one task; more are dealt over pairs of slices.
SLICE = 2_000
BROADCAST_ROWS = 500_000
#: Cost of a key's row against that of a comparison.
ROW_COST = 30.0
_BYTE_LANES = np.uint64(0x0101010101010101)


def shingle_prints(data: np.ndarray, bounds: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each row."""
    data = C.lowered(data)
    starts, ends, firsts = C.word_spans(data, bounds, C.SOLID_BYTES)
    n_words = np.diff(firsts)
    counts = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    row_of = np.repeat(np.arange(len(counts)), counts)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    first = firsts[row_of] + np.arange(cuts[-1]) - cuts[row_of]
    last = np.minimum(first + words, firsts[row_of + 1]) - 1
    raw = np.where(C.SOLID_BYTES[data], data, np.uint8(32)).tobytes()
    a, b = starts[first], ends[last]
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    plain = b - a == lengths[last + 1] - lengths[first] + (last - first)  # single characters between its words
    digest = xxhash.xxh64_digest
    if plain.all():
        hashed = b"".join([digest(raw[x:y], seed) for x, y in zip(a.tolist(), b.tolist())])
    else:
        hashed = b"".join([digest(raw[x:y] if p else b" ".join(raw[x:y].split()), seed) for x, y, p in zip(a.tolist(), b.tolist(), plain.tolist())])
    h = np.frombuffer(hashed, ">u8").astype(np.uint64)
    return majority(h, cuts)


def majority(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For the hashes of each row, the bits that are set in more than half of them.

    Eight sums of a byte each run side by side in a 64-bit integer, over blocks of 255 hashes."""
    counts = np.diff(cuts)
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if not len(full):
        return out
    blocks = (counts[full] + 254) // 255
    begin = np.concatenate([[0], np.cumsum(blocks)])
    at = np.repeat(cuts[:-1][full], blocks) + (np.arange(begin[-1]) - np.repeat(begin[:-1], blocks)) * 255
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _BYTE_LANES, at)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), begin[:-1], axis=0)
        bits = (2 * sums > counts[full][:, None]).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "fp": pa.array(shingle_prints(data, bounds, words, seed).view(np.int64))})

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


# --- partitions and thresholds ----------------------------------------------

def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of near equal size: each begins with the pair of free bits that
    correlate most and takes the bit that correlates most with those it has."""
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.float64)
    spread = bits.std(axis=0)
    bits = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    close = np.abs(bits.T @ bits) / max(1, len(sample))
    np.fill_diagonal(close, -1)
    free, groups = list(range(64)), []
    for size in [64 // m + (i < 64 % m) for i in range(m)]:
        sub = close[np.ix_(free, free)]
        group = [free[int(sub.max(axis=1).argmax())]]
        while len(group) < size:
            rest = [b for b in free if b not in group]
            group.append(rest[int(close[np.ix_(rest, group)].sum(axis=1).argmax())])
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def estimated(sample: np.ndarray, group: list[int], most: int, total: int) -> list[float]:
    """For thresholds 0 to ``most``, the pairs of all ``total`` fingerprints that would share a key of the
    group, by the pairs that do in the sample; at least what evenly spread bits would give."""
    scale = (total / max(1, len(sample))) ** 2
    found = []
    for t in range(most + 1):
        pairs, tables = 0.0, list(combinations(group, t))
        for cleared in tables[:64]:
            _, counts = np.unique(sample & np.uint64(_mask(set(group) - set(cleared))), return_counts=True)
            pairs += float((counts * (counts - 1.0) / 2).sum())
        even = total * total / 2.0 ** (len(group) - t + 1) * len(tables)
        found.append(max(pairs * len(tables) / max(1, min(64, len(tables))) * scale, even))
    return found


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 that add up to ``budget`` at the least cost; costs[i][t] is partition i's at
    threshold t, and -1 costs nothing.  A dynamic program over partitions and sums."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, len(own)):
                new = (cost + (own[t] if t >= 0 else 0.0), [*chosen, t])
                if total + t not in nxt or new[0] < nxt[total + t][0]:
                    nxt[total + t] = new
        best = nxt
    return best[budget]


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks, one for each table of keys: fingerprints at most ``distance`` apart agree under one of them."""
    choices = []
    for m in range(2, distance + 3):
        groups = bit_groups(sample, m)
        costs = [[ROW_COST * total * comb(len(g), t) + c for t, c in enumerate(estimated(sample, g, min(2, distance), total))] for g in groups]
        with np.errstate(all="ignore"):
            cost, thresholds = allocate(costs, distance - m + 1)
        choices.append((cost, [_mask(set(g) - set(cleared)) for g, t in zip(groups, thresholds) if t >= 0 for cleared in combinations(g, t)]))
    return min(choices)[1]


def rest_masks(mask: int, parts: int) -> list[int]:
    """The bits outside a mask in so many parts, as signed masks."""
    rest = [b for b in range(64) if not mask >> b & 1]
    found = [_mask(rest[i::parts]) for i in range(parts)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


# --- links --------------------------------------------------------------------

def _near(fps: np.ndarray, keys: np.ndarray, sides: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at most ``distance`` apart among rows of equal, adjacent keys, contracted as they are found.
    In a bucket with both sides, pairs are made across them; else among all its rows."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([new, [len(keys)]]))
    left = np.repeat(new + sizes, sizes) - np.arange(len(keys)) - 1  # rows after this one in its bucket
    found_a, found_b, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    active = np.flatnonzero(left > 0)
    step = 1
    while len(active):
        a, b = fps[active], fps[active + step]
        near = (np.bitwise_count(a ^ b) <= distance) & ((sides[active] < 0) | (sides[active] != sides[active + step]))
        found_a.append(a[near])
        found_b.append(b[near])
        held += int(near.sum())
        if held > 1_000_000:
            x, y = contract(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [x], [y], 0
        step += 1
        active = active[left[active] >= step]
    return contract(np.concatenate(found_a), np.concatenate(found_b))


def links(prints: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE, slice_rows: int = SLICE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``prints`` (fp) that connect all those at most ``distance``
    apart: not every such pair, but enough of them to reach each from each."""
    spark = prints.sparkSession
    total = prints.count()
    part = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, total)))).toArrow()
    masks = plan(part.column("fp").to_numpy().view(np.uint64), total, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("k")).select("fp", "k.t", "k.key")
    def crowded(keyed: DataFrame) -> tuple[DataFrame, int]:
        """The keys of more than ``slice_rows`` fingerprints, at most rows / slice_rows of them."""
        hot = keyed.groupBy("t", "key").count().filter(F.col("count") > slice_rows).select("t", "key", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
        hot = C.written(hot, "hot-keys")
        return hot, hot.count()

    hot, n_hot = crowded(keyed)
    if n_hot:
        # Fingerprints of a key differ elsewhere, in ``distance`` bits at most: they agree in one of as many parts of the rest and one more.
        rests = F.array(*(F.array(*map(F.lit, rest_masks(m, distance + 1))) for m in masks))
        parts = F.posexplode(F.transform(F.element_at(rests, F.col("t") + 1), lambda m: F.col("fp").bitwiseAND(m))).alias("part", "rest")
        inner = keyed.join(C.sized(hot, n_hot, 100_000), ["t", "key"]).select("fp", "t", "key", parts).select("fp", "t", F.xxhash64("key", "part", "rest").alias("key"))
        keyed = C.written(keyed.join(C.sized(hot, n_hot, 100_000), ["t", "key"], "left_anti").select("fp", "t", "key").unionByName(inner), "keys")
        # Keys that are crowded even so are dealt over pairs of slices.
        hot, n_hot = crowded(keyed)
    if n_hot:
        own = F.pmod(F.xxhash64("fp", "t"), F.col("slices")).cast("int")
        dealt = keyed.join(C.sized(hot, n_hot, 100_000), ["t", "key"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
        dealt = dealt.withColumn("other", other).select(
            "fp", "t", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            F.when(F.col("own") == F.col("other"), F.lit(-1)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
        )
    else:
        dealt = keyed.select("fp", "t", "key", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(-1).alias("side"))
    bucket = F.xxhash64("t", "key", "low", "high")
    dealt = dealt.select(bucket.alias("bucket"), "fp", "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket cut by a batch's end is carried to the next batch."""
        rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

        def told(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _near(cols[1], cols[0], cols[2], distance)
            return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("side").to_numpy().astype(np.int64)]
            cols = [np.concatenate(x) for x in zip(rest, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [x[cut:] for x in cols]
            if cut:
                yield told([x[:cut] for x in cols])
        if len(rest[0]):
            yield told(rest)

    # Buckets that meet under one hash are compared too, which adds comparisons but no wrong links.
    n = C.shuffle_partitions(spark)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the
    smallest doc_id that links reach).

    Texts of fewer words than a shingle are one shingle; null texts, empty ones and those of white
    space have the fingerprint zero and are linked like any other.  Equal fingerprints are one node.
    Null doc_ids are never a component's id unless it has no other.  Repeated rows are kept;
    further columns are ignored."""
    prints = C.written(fingerprints(docs, words), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = C.written(nodes, "nodes")
    n = nodes.count()
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(C.sized(roots.withColumnRenamed("node", "fp"), roots.count(), BROADCAST_ROWS), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(C.sized(labels, n, BROADCAST_ROWS), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
