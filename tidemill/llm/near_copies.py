"""Near copies by the Jaccard similarity of their five-word shingles.

Fingerprints propose first: SimHash over the same shingles, linked under the generalised pigeonhole
principle of :mod:`simhash`.  Similar sets reach beyond what fingerprints of 64 bits tell (at 0.8 they
differ in some ten), so MinHash bands propose the rest: documents that agree on all rows of a band share
a key.  What fingerprints have linked is one document to the bands.  Sketches tell pairs
that aren't similar: a shingle turns one of a sketch's bits over, so two sketches differ in as many
bits at most as the sets do in shingles, and in nearly as many with four bits a shingle.  The sets of
shingles themselves decide: only pairs whose exact similarity reaches SIMILAR are linked.

In rounds, each key's documents are compared with one of them.  In keys that hold documents of
several components after that, sketches of those are compared in the tasks that the keys are dealt
to, and only pairs that may be similar leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import simhash
from .components import components

WORDS = 5
#: Least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: At similarity 0.8 a pair shares no key with a chance of (1 - 0.8**ROWS)**BANDS, about 1e-7.
BANDS, ROWS = 40, 5
#: Rounds in which each key's documents are compared with one of them, while its pairs are over PAIRS times its rows.
STARS, PAIRS = 3, 1
#: Bits of a sketch for each shingle, at least; their number is a power of two.
SKETCH = 4
#: Documents of a key that are compared in one task (more are dealt over pairs of slices), and pairs compared at once.
SLICE = 1_000
AT_ONCE = 1 << 15
BROADCAST_ROWS = 500_000
#: Sketches up to which they are broadcast, by their number and bytes.
BROADCAST_SKETCHES, BROADCAST_BYTES = 100_000, 32 << 20
_SEEDS = C.mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles as sorted hashes, and the rows' bounds in them.  A row of fewer words is one shingle."""
    data = C.lowered(data)
    starts, ends, firsts = C.word_spans(data, bounds, C.SOLID_BYTES)
    own = C.span_hashes(C.prefix_sums(data), starts, ends)
    n_words = np.diff(firsts)
    found, rows = [], []
    for k in [words, *(k for k in range(1, words) if (n_words == k).any())]:
        h, at = C.shingle_hashes(own, firsts, k)
        row = np.searchsorted(firsts, at, "right") - 1
        fits = n_words[row] == k if k < words else np.ones(len(row), bool)
        found.append(h[fits])
        rows.append(row[fits])
    h, row = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[once], np.searchsorted(row[once], np.arange(len(bounds)))


def nodes_of(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 of an empty one."""
    out = np.zeros(len(cuts) - 1, np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        out[full] = C.mixed(np.add.reduceat(C.mixed(h + np.uint64(1)), cuts[:-1][full]) + np.diff(cuts)[full].astype(np.uint64))
    return out


def band_keys(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of each set that isn't empty, its bands' keys: sets by BANDS."""
    at = cuts[:-1][np.diff(cuts) > 0]
    keys = np.zeros((len(at), BANDS), np.uint64)
    for k in range(BANDS * ROWS if len(at) else 0):
        band = k // ROWS
        low = np.minimum.reduceat((h ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1)), at)
        keys[:, band] = C.mixed((keys[:, band] if k % ROWS else np.uint64(band + 1)) + low)
    return keys


def sketches(h: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Of each set its sketch: which bits an odd number of its hashes fall on."""
    sizes = np.diff(cuts)
    bits = np.exp2(np.ceil(np.log2(np.maximum(sizes * SKETCH, 64)))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = begin[row] + (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(begin[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[a >> 3:b >> 3] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


class Sketches:
    """Sketches of several lengths, to be compared by their places."""

    def __init__(self, raw: list[bytes]):
        self.length = np.array([len(x) for x in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == n)
            self.place[own] = np.arange(len(own))
            self.rows[n] = np.frombuffer(b"".join(raw[i] for i in own.tolist()), "<u8").reshape(len(own), -1)

    def _folded(self, own: np.ndarray, n: int, to: int) -> np.ndarray:
        """The sketches with their halves laid over one another until they have ``to`` bytes: what the shorter sketch of the same set would be."""
        found = self.rows[n][self.place[own]]
        while n > to:
            n //= 2
            half = found.shape[1] // 2
            found = found[:, :half] ^ found[:, half:]
        return found

    def near(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, other: Sketches | None = None) -> np.ndarray:
        """Of pairs of places (``b`` among ``other``'s, if given), whether the sketches differ in ``most`` bits at most."""
        other = self if other is None else other
        out = np.zeros(len(a), bool)
        kind = self.length[a] << 32 | other.length[b]
        for k in np.unique(kind).tolist():
            n, m = k >> 32, k & 0xFFFFFFFF
            for own in np.array_split(np.flatnonzero(kind == k), 1 + int((kind == k).sum()) // AT_ONCE):
                x, y = self._folded(a[own], n, min(n, m)), other._folded(b[own], m, min(n, m))
                out[own] = np.bitwise_count(x ^ y).sum(axis=1) <= most[own]
        return out


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles similar sets of such sizes differ in, at most."""
    return (a + b) * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[1] + SIMILAR[0])


def _with_nodes(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` and each row's node."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            yield rows.append_column(column, pa.array(nodes_of(*shingle_sets(data, bounds)).view(np.int64)))

    return docs.mapInArrow(work, docs.withColumn(column, F.lit(0).cast("long")).schema)


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, size, fp (the fingerprint) and keys (none of an empty set)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            h, cuts = shingle_sets(data, bounds)
            ends = np.concatenate([[0], np.cumsum(np.where(np.diff(cuts) > 0, BANDS, 0))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(h, cuts).reshape(-1).view(np.int64)))
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "node": pa.array(nodes_of(h, cuts).view(np.int64)), "size": pa.array(np.diff(cuts).astype(np.int64)), "fp": pa.array(simhash.majority(C.mixed(h), cuts).view(np.int64)), "keys": keys})

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, size long, fp long, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """node and its hashes, of each row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in C.chunks(batches):
            h, cuts = shingle_sets(data, bounds)
            sets = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.record_batch({"node": pa.array(nodes_of(h, cuts).view(np.int64)), "hashes": sets})

    return docs.select("text").mapInArrow(work, "node long, hashes array<long>")


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) and whether their sets are similar.  Spark compares them, as batches of pairs of sets would fill a Python worker."""
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    pairs = pairs.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return pairs.select("a", "b", (F.col("shared") * SIMILAR[1] >= (F.col("n") - F.col("shared")) * SIMILAR[0]).alias("near"))


def _sketches(sets: DataFrame) -> DataFrame:
    """node and its sketch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.record_batch({"node": batch.column("node"), "sketch": pa.array(sketches(lists.flatten().to_numpy().view(np.uint64), cuts), pa.binary())})

    return sets.mapInArrow(work, "node long, sketch binary")


def _alike(a: Column | str, b: Column | str) -> Column:
    """Whether sets of such sizes can be similar."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _agreeing(pairs: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, m, n: their sizes) whose sketches don't tell them apart."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                most = unlike(batch.column("m").to_numpy(), batch.column("n").to_numpy())
                same = Sketches(batch.column("x").to_pylist()).near(every, every, most, Sketches(batch.column("y").to_pylist()))
                yield batch.select(["a", "b"]).filter(pa.array(same))

    for end, name in (("a", "x"), ("b", "y")):
        side = known.select(F.col("node").alias(end), F.col("sketch").alias(name))
        pairs = pairs.join(C.sized(side, n_known, BROADCAST_SKETCHES), end)
    return pairs.mapInArrow(work, "a long, b long")


def agreeing_within(bucket: np.ndarray, side: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ordered by bucket, the pairs in one bucket (across its sides, if it has them) with different roots and with sizes and
    sketches that don't tell them apart, as numbers of rows."""
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(new, len(bucket)))
    left = np.repeat(new + sizes, sizes) - np.arange(len(bucket)) - 1  # rows after this one in its bucket
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    active, step = np.flatnonzero(left > 0), 1
    while len(active):
        a, b = active, active + step
        may = (root[a] != root[b]) & ((side[a] < 0) | (side[a] != side[b])) & (np.minimum(size[a], size[b]) * SIMILAR[1] >= np.maximum(size[a], size[b]) * SIMILAR[0])
        a, b = a[may], b[may]
        same = sketch.near(a, b, unlike(size[a], size[b]))
        found.append((a[same], b[same]))
        step += 1
        active = active[left[active] >= step]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _compared(here: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a key and agree, of different roots; ``here`` (key, n, node, size, root)."""
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), slices).cast("int")
    dealt = here.select("key", "node", "size", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("other")).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "size", "root",
        F.when(F.col("own") == F.col("other"), F.lit(-1)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
    )
    names = ["bucket", "side", "root", "size", "node"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket cut by a batch's end is carried to the next batch."""
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * len(names)
        raw: list[bytes] = []

        def told(x: list[np.ndarray], raw: list[bytes]) -> pa.RecordBatch:
            i, j = agreeing_within(*x[:4], Sketches(raw))
            a, b = x[4][i], x[4][j]
            return pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(rest, names)]
            raw += batch.column("sketch").to_pylist()
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield told([x[:cut] for x in cols], raw[:cut])
            rest, raw = [x[cut:] for x in cols], raw[cut:]
        if raw:
            yield told(rest, raw)

    dealt = dealt.join(C.sized(known, n_known, BROADCAST_SKETCHES), "node")
    n = C.shuffle_partitions(here.sparkSession)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(work, "a long, b long").distinct()


def _print_pairs(marks: DataFrame) -> DataFrame:
    """Pairs (a, b, m, n: their sizes) of nodes whose fingerprints :func:`simhash.links` connects, and of each node with the first of its fingerprint;
    their number grows with that of the nodes."""
    sets = marks.filter("size > 0").select("node", "size", "fp").distinct()
    firsts = C.written(sets.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    several = C.written(firsts.filter("n > 1").select("fp", "first"), "shared-prints")
    same = sets.join(C.sized(several, several.count(), BROADCAST_ROWS), "fp").select(F.struct("node", "size").alias("x"), F.col("first").alias("y"))
    links = C.written(simhash.links(firsts.select("fp")), "print-links")
    ends = C.sized(firsts, firsts.count(), BROADCAST_ROWS)
    near = links.join(ends.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(ends.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    pairs = same.unionByName(near).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter((F.col("x") != F.col("y")) & _alike("x.size", "y.size"))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.size").alias("m"), F.col("y.size").alias("n")).distinct()


def _roots(docs: DataFrame, marks: DataFrame) -> DataFrame | None:
    """The nodes that links connect with a smaller one, and the smallest: node, root."""
    told = C.written(_print_pairs(marks), "print-pairs")
    n_told = told.count()
    keyed = marks.select("node", "size", F.explode("keys").alias("key"))
    shared = C.written(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key"), "shared-keys")
    n_shared = shared.count()
    if not n_shared and not n_told:
        return None
    members = C.written(keyed.join(C.sized(shared, n_shared, BROADCAST_ROWS), "key").distinct(), "members")
    ends = told.select(F.explode(F.array("a", "b")).alias("node"))
    active = C.written(members.select("node").unionByName(ends).distinct(), "active")
    n_active = active.count()
    sets = C.written(C.joined(_sets(docs), active, ["node"], "left_semi", n_active, BROADCAST_ROWS).groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    known = C.written(_sketches(sets), "sketches")
    n_known = n_active if (known.agg(F.sum(F.octet_length("sketch"))).first()[0] or 0) <= BROADCAST_BYTES else BROADCAST_SKETCHES + 1
    roots = judged = None
    if n_told:
        judged = C.written(_judged(_agreeing(told, known, n_known), sets), "judged")
        roots = components(judged.filter("near").select("a", "b"))
    for star in range(STARS + 1):
        now = members.withColumn("root", F.col("node"))
        if roots is not None:
            now = members.join(C.sized(roots, roots.count(), BROADCAST_ROWS), "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = F.min(F.struct(F.xxhash64("node", F.lit(star)).alias("rank"), "node", "size", "root")).alias("first")
        left = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), first)
        left = C.written(left.filter("low <> high").select("key", "n", "first"), "open-keys")
        n_left, rows, most = left.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.expr("n * (n - 1.0d) / 2"))).first()
        if not n_left:
            break
        last = star == STARS or most <= PAIRS * rows
        here = now.join(C.sized(left, n_left, BROADCAST_ROWS), "key")
        if last:
            pairs = _compared(here.select("key", "n", "node", "size", "root"), known, n_known)
        else:
            pairs = here.filter((F.col("root") != F.col("first.root")) & _alike("size", "first.size"))
            turned = F.col("node") > F.col("first.node")
            sizes = F.when(turned, F.struct(F.col("first.size").alias("m"), F.col("size").alias("n"))).otherwise(F.struct(F.col("size").alias("m"), F.col("first.size").alias("n")))
            pairs = pairs.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b"), sizes.alias("s")).select("a", "b", "s.m", "s.n").distinct()
            pairs = _agreeing(pairs, known, n_known)
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        new = C.written(_judged(pairs, sets), "judged")
        judged = new if judged is None else judged.unionByName(new)
        roots = components(judged.filter("near").select("a", "b"))
        if last:
            break
    return roots


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, node, component_id (the smallest doc_id that links
    reach), kept.  Documents are linked if the similarity of their sets of shingles is SIMILAR or more.

    Null texts, empty ones and those of white space have empty sets, which are equal.  A null doc_id comes
    after all others.  Of a component the rows of the smallest doc_id are kept, and if rows of that
    doc_id have several sets, those of one of the sets; so repeated rows are kept or not alike.
    Further columns are ignored."""
    marks = C.written(_signatures(docs), "signatures")
    roots = _roots(docs, marks)
    rooted = marks.select("doc_id", "node").withColumn("root", F.col("node"))
    if roots is not None:
        rooted = marks.select("doc_id", "node").join(C.sized(roots, roots.count(), BROADCAST_ROWS), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = C.written(rooted, "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    several = C.written(rooted.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "several")
    rooted = rooted.join(C.sized(several, several.count(), BROADCAST_ROWS), "root", "left")
    alone = F.col("first").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node")))
    return rooted.select("doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_copies` keeps, with all their columns; null, repeated and equal doc_ids as told there."""
    gone = C.written(near_copies(docs).filter("not kept").select("doc_id", F.col("node").alias("_node")).distinct(), "near-copies")
    return C.joined(_with_nodes(docs, "_node"), gone, ["doc_id", "_node"], "left_anti", gone.count(), BROADCAST_ROWS).select(*docs.columns)
