"""Removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller
doc_id.  Of each such string the q-gram with the smallest hash is an anchor, so equal strings have
equal anchors, and only a suffix in some fourteen enters the work.

1. Copies of whole texts are told by grouping on the text's SHA-256; all but the first are out.
2. Initial buckets are the anchors' q-grams.  Tasks send owners of hash ranges Golomb-coded lists
   of them; owners answer with a bitmap of buckets in several documents and the list of those with
   very many rows.  Where the bitmap would be too dense, documents are dealt to blocks first, and
   owners answer each block.
3. Rows of the marked buckets carry the bytes that strings over the anchor can reach; places with the
   same bytes are put in one row before they leave a task.  A bucket's rows meet in one task, where
   buckets of suffixes are refined by sorting on the buckets of later offsets, which have been
   refined before.  Neighbours in the final order are compared byte for byte, and of equal strings
   the smallest doc_id tells which are repeated.
4. Buckets of very many rows don't meet in one task: each of their strings is a key of its own, byte
   for byte, combined in the map tasks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common as C
from .exact_dedup import golomb_decode, golomb_encode

LENGTH = 50
Q = 28
#: Rows of a bucket that may meet in one task.
HOT_ROWS = 4_000
#: Bits of the bitmap of marked buckets, at most (256 MB).  If there are more than twice as many anchors (at least 20 GB of
#: text), documents are dealt to blocks instead.
BITMAP_BITS = 31
#: Bytes of text in a block, about.
BLOCK_BYTES = 64 << 20
#: Rows, and intervals in them, up to which a table is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_CONTEXTS = 50_000
BROADCAST_INTERVALS = 2_000_000
#: Rows that a task gathers before it sends their bytes, rows of a batch that it sends, and bytes of text that it turns into arrays at once.
GATHER = 100_000
SENT = 10_000
#: Intervals of hot buckets that a task gathers before it makes those that meet one.
MET = 300_000
#: Bytes of an initial bucket, and neighbours that are compared at once.
STEP = 8
SLICE = 1 << 18
CHUNK = 1 << 19
_LAST = (1 << 63) - 1
_NONE = np.zeros(0, np.int64)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours, from running ones of blocks in both directions."""
    blocks = np.concatenate([x, np.full(-len(x) % width, x[-1], x.dtype)]).reshape(-1, width)
    to, since = pick.accumulate(blocks, axis=1).reshape(-1), pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(x) - width + 1
    return pick(since[:n], to[width - 1:width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors, hashes of their grams, and the hashes' prefix sums.  Equal q-grams of one string are all anchors.

    The least of several hashes is a small number, so hashes are mixed once more before they share out work."""
    if len(data) < length:
        return _NONE, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = C.prefix_sums(data)
    starts = np.arange(len(data) - q + 1)
    h = C.span_hashes(sums, starts, starts + q) | np.uint64(1)
    width = length - q + 1
    least = _sliding(h, width, np.minimum)
    row_ends = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
    least[np.arange(len(least)) + length > row_ends] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    return at, C.mixed(h[at]), sums


# --- buckets in several documents -------------------------------------------

def _prints(batches: Iterator[pa.RecordBatch], bits: int, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading ``bits`` bits of all anchors' hashes in order, and the documents that have them, by number."""
    prints, owner_doc, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
    for rows, data, bounds in C.chunks(batches, limit=CHUNK):
        at, h, _ = anchors(data, bounds, length, q)
        prints.append(h >> np.uint64(64 - bits))
        owner_doc.append((np.searchsorted(bounds, at, "right") - 1 + base).astype(np.int32))
        base += rows.num_rows
    fp, doc = np.concatenate(prints), np.concatenate(owner_doc)
    order = np.argsort(fp, kind="stable")  # documents stay in order
    return fp[order], doc[order]


def _listed(fp: np.ndarray, doc: np.ndarray, owners: int, bits: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """The owners that a sender has buckets for, one Golomb-coded list for each, and with it marks of those buckets that
    several documents have and the magnitudes of the numbers of their rows."""
    new = np.concatenate([[True], fp[1:] != fp[:-1]])[: len(fp)]
    values, first = fp[new], np.flatnonzero(new)
    counts = np.diff(np.append(first, len(fp)))
    several = doc[first] != doc[first + counts - 1]
    marks = np.where(counts > 1, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 63) | (several.astype(np.int64) << 6), 0).astype(np.uint8)
    starts = _range_starts(owners, bits)
    cuts = np.append(np.searchsorted(values, starts), len(values))
    full = np.flatnonzero(np.diff(cuts))
    codes, told = [], []
    for o in full.tolist():
        a, b = cuts[o], cuts[o + 1]
        codes.append(golomb_encode(values[a:b] - starts[o]))
        m = marks[a:b]
        told.append(np.packbits(m > 0).tobytes() + m[m > 0].tobytes())
    return full, codes, told


def _pooled(table: pa.Table, start: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What an owner was sent: the lists, all their values in order, whether several documents have each, and about how many rows."""
    lists, rows, several = [], [], []
    for code, marks in zip(table.column("code").to_pylist(), table.column("marks").to_pylist()):
        v = golomb_decode(code)
        n = (len(v) + 7) // 8
        held = np.unpackbits(np.frombuffer(marks, np.uint8, n))[: len(v)] > 0
        m = np.zeros(len(v), np.uint8)
        m[held] = np.frombuffer(marks, np.uint8, offset=n)
        lists.append(v + np.uint64(start))
        rows.append(np.exp2(np.maximum(m & 63, 1) - 1.0))
        several.append(m >> 6)
    v = np.concatenate(lists)
    order = np.argsort(v, kind="stable")
    v = v[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    shared = (np.diff(np.append(first, len(v))) > 1) | (np.add.reduceat(np.concatenate(several)[order].astype(np.int64), first) > 0)
    return lists, v[first], shared, np.add.reduceat(np.concatenate(rows)[order], first)


def _send(rest: DataFrame, owners: int, bits: int, length: int, q: int) -> DataFrame:
    """Each task's lists of buckets for the owners."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, codes, told = _listed(*_prints(batches, bits, length, q), owners, bits)
        yield pa.record_batch({"owner": pa.array(full, pa.int32()), "code": pa.array(codes, pa.binary()), "marks": pa.array(told, pa.binary())})

    return rest.mapInArrow(work, "owner int, code binary, marks binary")


def _range_starts(owners: int, bits: int) -> np.ndarray:
    return np.array([(o << bits) // owners + (1 if (o << bits) % owners else 0) for o in range(owners)], np.uint64)


def _marked(lists: DataFrame, owners: int, bits: int, map_bits: int, hot_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of buckets that several documents have, and the sorted fingerprints of those of more than ``hot_rows`` rows."""

    def own(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, v, shared, size = _pooled(table, int(_range_starts(owners, bits)[key[0].as_py()]))
        v, size = v[shared], size[shared]
        slots = (v >> np.uint64(bits - map_bits)).astype(np.int64)
        low = int(slots[0]) >> 3 if len(slots) else 0
        part = np.zeros((int(slots[-1]) >> 3) - low + 1 if len(slots) else 0, np.uint8)
        np.bitwise_or.at(part, (slots >> 3) - low, (1 << (slots & 7)).astype(np.uint8))
        return pa.table({"at": pa.array([low], pa.int64()), "bits": pa.array([part.tobytes()], pa.binary()), "hot": pa.array([v[size > hot_rows].astype(np.int64)], pa.list_(pa.int64()))})

    table, hot = np.zeros(1 << (map_bits - 3), np.uint8), [_NONE]
    parts = lists.groupBy("owner").applyInArrow(own, "at long, bits binary, hot array<long>").toArrow()  # bounded: the bitmap's size
    for low, packed, own_hot in zip(parts.column("at").to_pylist(), parts.column("bits").to_pylist(), parts.column("hot").to_pylist()):
        part = np.frombuffer(packed, np.uint8)
        table[low:low + len(part)] |= part
        hot.append(np.array(own_hot, np.int64))
    return table, np.sort(np.concatenate(hot)).astype(np.uint64)


# --- rows of the marked buckets -----------------------------------------------

#: A row stands for the anchors of one bucket and one context that a task has gathered: ``bytes`` are all that strings over the
#: anchor reach, ``before`` of them in front of it; ``members`` are the places, by rank, of which ``first`` is the smallest and ``last`` the largest.
_ROW = "bucket long, context long, before int, bytes binary, first long, last long, members binary"
_ARROW_ROW = pa.schema([("bucket", pa.int64()), ("context", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("members", pa.binary())])
_MEMBER = np.dtype([("rank", "<i8"), ("part", "<i4"), ("pos", "<i4")])


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and their sizes."""
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    bounds = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], np.diff(bounds)


def _row_batches(batches: Iterator[pa.RecordBatch], pick, bits: int, length: int, q: int) -> Iterator[pa.RecordBatch]:
    """The rows of the anchors whose fingerprint ``pick`` takes.  Bucket and context are hashes of the q-gram and of the bytes around;
    places are put in one row only if the bytes themselves are equal."""
    reach = length - q
    held: list[tuple] = []
    n_held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        bucket, context, rank, part, pos, before, size, raw = (np.concatenate([x[i] for x in held]) for i in range(8))
        raw[np.arange(raw.shape[1])[None, :] >= size[:, None]] = 0
        while True:
            order = np.lexsort((rank, context, bucket))
            head = np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (context[order][1:] != context[order][:-1])])
            lead = order[head][np.cumsum(head) - 1]
            differs = order[(raw[order] != raw[lead]).any(axis=1) | (before[order] != before[lead]) | (size[order] != size[lead])]
            if not len(differs):
                break
            context[differs] = C.mixed(context[differs] + np.uint64(1))  # equal hashes of different bytes
        lead, begin = order[head], np.flatnonzero(head)
        n = np.diff(np.append(begin, len(order)))
        members = np.empty(len(order), _MEMBER)
        members["rank"], members["part"], members["pos"] = rank[order], part[order], pos[order]
        whole = pa.RecordBatch.from_arrays([
            pa.array(bucket[lead].view(np.int64)), pa.array(context[lead].view(np.int64)), pa.array(before[lead].astype(np.int32)),
            _binary(raw[lead][np.arange(raw.shape[1])[None, :] < size[lead][:, None]], size[lead]),
            pa.array(rank[lead]), pa.array(rank[order][begin + n - 1]), _binary(members.view(np.uint8), n * _MEMBER.itemsize),
        ], schema=_ARROW_ROW)
        for k in range(0, whole.num_rows, SENT):
            yield whole.slice(k, SENT)

    for rows, data, bounds in C.chunks(batches, limit=CHUNK):
        at, h, sums = anchors(data, bounds, length, q)
        keep = pick(h >> np.uint64(64 - bits)) if len(at) else np.zeros(0, bool)
        at, h = at[keep], h[keep]
        if not len(at):
            continue
        row = np.searchsorted(bounds, at, "right") - 1
        before, after = np.minimum(reach, at - bounds[row]), np.minimum(length, bounds[row + 1] - at)
        context = C.mixed(C.span_hashes(sums, at - before, at + after) ^ before.astype(np.uint64))
        window = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(reach + length, np.uint8)]), reach + length)
        rank, part = rows.column("rank").to_numpy(), rows.column("part").to_numpy()
        held.append((h, context, rank[row], part[row], at - bounds[row], before, before + after, window[at - before]))
        n_held += len(at)
        if n_held > GATHER:
            yield from sent()
            held, n_held = [], 0
    if held:
        yield from sent()


def _rows(rest: DataFrame, known, bits: int, map_bits: int, hot: bool, length: int, q: int) -> DataFrame:
    """The rows of buckets that the bitmap marks, of those with very many rows or of the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot_prints = known.value

        def pick(fp: np.ndarray) -> np.ndarray:
            slot = fp >> np.uint64(bits - map_bits)
            keep = (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found = np.minimum(np.searchsorted(hot_prints, fp), len(hot_prints) - 1)
            return keep & ((hot_prints[found] == fp) == hot if len(hot_prints) else not hot)

        yield from _row_batches(batches, pick, bits, length, q)

    return rest.mapInArrow(work, _ROW)


def _dealt_rows(rest: DataFrame, owners: int, blocks: int, bits: int, hot_rows: int, length: int, q: int) -> tuple[DataFrame, DataFrame]:
    """The same rows, of ordinary buckets and of those with very many rows, where a bitmap would be too dense: documents are dealt to
    blocks by a hash, and owners answer every block's list with two bits for each of its buckets."""
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("rank", "part"), F.lit(blocks)).cast("int"))

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        full, codes, told = _listed(*_prints(table.to_batches(), bits, length, q), owners, bits)
        return pa.table({"block": pa.array([key[0].as_py()] * len(full), pa.int32()), "owner": pa.array(full, pa.int32()), "code": pa.array(codes, pa.binary()), "marks": pa.array(told, pa.binary())})

    def own(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists, v, shared, size = _pooled(table, int(_range_starts(owners, bits)[key[0].as_py()]))
        flags = shared.astype(np.uint8) + (shared & (size > hot_rows))
        told = [np.packbits((flags[np.searchsorted(v, x)][:, None] >> np.array([0, 1], np.uint8)) & 1).tobytes() for x in lists]
        return pa.table({"block": table.column("block"), "owner": table.column("owner"), "flags": pa.array(told, pa.binary())})

    answers = C.written(dealt.groupBy("block").applyInArrow(send, "block int, owner int, code binary, marks binary").groupBy("owner").applyInArrow(own, "block int, owner int, flags binary"), "answers")

    def taken(hot: bool):
        def take(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
            values = np.unique(_prints(table.to_batches(), bits, length, q)[0])
            cuts = np.append(np.searchsorted(values, _range_starts(owners, bits)), len(values))
            flags = np.zeros(len(values), np.uint8)
            for o, packed in zip(told.column("owner").to_pylist(), told.column("flags").to_pylist()):
                n = cuts[o + 1] - cuts[o]
                bit = np.unpackbits(np.frombuffer(packed, np.uint8))[: 2 * n].reshape(n, 2)
                flags[cuts[o]:cuts[o + 1]] = bit[:, 0] + 2 * bit[:, 1]
            wanted = flags == 2 if hot else flags == 1  # one more than shared: very many rows
            return pa.Table.from_batches(list(_row_batches(table.to_batches(), lambda fp: wanted[np.searchsorted(values, fp)], bits, length, q)), _ARROW_ROW)
        return take

    cold, hot = (dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(taken(x), _ROW) for x in (False, True))
    return cold, hot


def string_buckets(text: np.ndarray, length: int, columns: int) -> np.ndarray:
    """Identifiers of the strings of ``length`` bytes (STEP or more) that begin in the first ``columns`` columns of a byte matrix, equal for
    equal strings of one column.

    Every suffix of a row begins in the bucket of its first STEP bytes and points at the bucket of the suffix STEP bytes on.  A bucket is
    refined by sorting on what its suffixes point at; from the last columns to the first, so that all that a bucket points at has been
    refined before, by what that points at in turn.  Equal strings then stand together in the order of the suffixes, and neighbours are
    compared byte for byte."""
    span = columns - 1 + length
    wide = np.zeros((len(text), span + STEP), np.uint8)
    wide[:, : min(span, text.shape[1])] = text[:, :span]
    value = np.zeros((len(text), span), np.uint64)
    for j in range(STEP):
        value = (value << np.uint64(8)) | wide[:, j:j + span]
    bucket = np.unique(value, return_inverse=True)[1].reshape(value.shape).astype(np.int64)
    for a in range((span - 1) // STEP * STEP - STEP, -1, -STEP):
        later = bucket[:, a + STEP:a + 2 * STEP]
        pair = bucket[:, a:a + later.shape[1]] * (int(bucket.max()) + 1) + later
        bucket[:, a:a + later.shape[1]] = np.unique(pair, return_inverse=True)[1].reshape(pair.shape)
    suffix = bucket[:, :columns] + np.arange(columns) * (int(bucket.max(initial=0)) + 1)
    order = np.argsort(suffix, axis=None, kind="stable")
    row, col = np.divmod(order, columns)
    strings = np.lib.stride_tricks.sliding_window_view(wide, length, axis=1)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), SLICE):
        to = slice(at, min(at + SLICE, len(order)))
        back = slice(to.start - 1, to.stop - 1)
        new[to] = (col[to] != col[back]) | (strings[row[to], col[to]] != strings[row[back], col[back]]).any(axis=1)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids.reshape(len(text), columns)


def resolved(bucket: np.ndarray, context: np.ndarray, before: np.ndarray, flat: np.ndarray, sizes: np.ndarray, members: np.ndarray, counts: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of whole buckets, their bytes end to end, and their members: which members have bytes to remove, from where to where."""
    reach = length - q
    text = np.zeros((len(bucket), reach + length), np.uint8)  # the anchors stand below one another
    cell = np.arange(reach + length)[None, :] - (reach - before)[:, None]
    text[(cell >= 0) & (cell < sizes[:, None])] = flat
    low, high = np.maximum(0, length - (sizes - before)), before  # offsets of the strings' starts before the anchor
    begin = np.cumsum(counts) - counts
    # Rows of different tasks with the same bytes are one.
    order = np.lexsort((context, bucket))
    a, b = order[1:], order[:-1]
    head = np.concatenate([[True], (bucket[a] != bucket[b]) | (context[a] != context[b]) | (before[a] != before[b]) | (sizes[a] != sizes[b]) | (text[a] != text[b]).any(axis=1)])
    group = np.empty(len(bucket), np.int64)
    group[order] = np.cumsum(head) - 1
    lead = order[head]
    first = np.minimum.reduceat(members["rank"][begin][order], np.flatnonzero(head))
    # Of buckets with several texts, the strings one by one.
    of = bucket[lead]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    own = np.diff(np.append(cut, len(of)))
    several = np.flatnonzero(np.repeat(own > 1, own))
    found_low, found_high = np.full(len(lead), reach + 1), np.full(len(lead), -1)
    if len(several):
        source = lead[several]
        ids = string_buckets(text[source], length, reach + 1)  # column c: the string that starts reach - c before the anchor
        offset = reach - np.arange(reach + 1)[None, :]
        valid = (offset >= low[source][:, None]) & (offset <= high[source][:, None])
        where, offset = several[np.nonzero(valid)[0]], np.broadcast_to(offset, valid.shape)[valid]
        least = np.full(int(ids.max()) + 1, _LAST)
        np.minimum.at(least, ids[valid], first[where])
        hit = np.flatnonzero(least[ids[valid]] < first[where])
        np.minimum.at(found_low, where[hit], offset[hit])
        np.maximum.at(found_high, where[hit], offset[hit])
    row = np.repeat(np.arange(len(bucket)), counts)
    later = members["rank"] > first[group[row]]
    a, b = np.where(later, low[row], found_low[group[row]]), np.where(later, high[row], found_high[group[row]])
    gone = np.flatnonzero(b >= a)
    pos = members["pos"][gone].astype(np.int64)
    return gone, pos - b[gone], pos - a[gone] + length


_INTERVAL = "rank long, part int, a int, b int"


def _intervals(members: np.ndarray, gone: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return _told(members["rank"][gone], members["part"][gone], a, b)


def _told(rank: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"rank": pa.array(np.ascontiguousarray(rank)), "part": pa.array(np.ascontiguousarray(part)), "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32))})


def met(rank: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Intervals of documents with those that meet made one."""
    order = np.lexsort((a, part, rank))
    rank, part, a, b = rank[order], part[order], a[order], b[order]
    doc = np.cumsum(np.concatenate([[False], (rank[1:] != rank[:-1]) | (part[1:] != part[:-1])])[: len(rank)])
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
    doc, a, b = merged_runs(doc, a, b)
    return [rank[first][doc], part[first][doc], a, b]


def _cold_intervals(rows: DataFrame, length: int, q: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket cut by a batch's end waits for the rest."""
        held: list[np.ndarray] | None = None  # bucket, context, before, bytes, sizes, members, counts

        def told(x: list[np.ndarray]) -> pa.RecordBatch:
            return _intervals(x[5], *resolved(*x, length, q))

        for batch in batches:
            if not batch.num_rows:
                continue
            flat, sizes = _flat(batch.column("bytes"))
            members, counts = _flat(batch.column("members"))
            new = [batch.column("bucket").to_numpy(), batch.column("context").to_numpy(), batch.column("before").to_numpy().astype(np.int64), flat, sizes, members.view(_MEMBER), counts // _MEMBER.itemsize]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) < 15_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                cuts = [cut, cut, cut, int(held[4][:cut].sum()), cut, int(held[6][:cut].sum()), cut]
                yield told([x[:c] for x, c in zip(held, cuts)])
                held = [x[c:] for x, c in zip(held, cuts)]
        if held is not None:
            yield told(held)

    n = C.shuffle_partitions(rows.sparkSession)
    return rows.drop("first", "last").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(work, _INTERVAL)


def _hot_intervals(rows: DataFrame, length: int, q: int) -> DataFrame:
    """The same for buckets of very many rows: their contexts and strings are keys, byte for byte, and the smallest ranks of each are
    combined in the map tasks."""
    context = ["bucket", "before", "bytes"]
    rows = C.written(rows, "hot-rows")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, sizes = _flat(batch.column("bytes"))
            before = batch.column("before").to_numpy().astype(np.int64)
            low = np.maximum(0, length - (sizes - before))
            count = np.maximum(before - low + 1, 0)
            row = np.repeat(np.arange(batch.num_rows), count)
            offset = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = (np.cumsum(sizes) - sizes)[row] + before[row] - offset
            string = data[at[:, None] + np.arange(length)[None, :]]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "bucket", "first")), pa.array(offset.astype(np.int32)), _binary(string.reshape(-1), np.full(len(row), length))], ["id", "bucket", "rank", "offset", "string"])

    contexts = rows.groupBy(*context).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    contexts = C.written(contexts.withColumn("id", F.monotonically_increasing_id()), "hot-contexts")
    each = C.written(contexts.mapInArrow(strings, "id long, bucket long, rank long, offset int, string binary"), "hot-strings")
    # Strings of several contexts are few; the join is dealt by a table, so that a string of very many contexts can be split.
    least = each.groupBy("bucket", "offset", "string").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").drop("most")
    least = C.written(least, "hot-least")
    found = each.join(C.sized(least, least.count(), BROADCAST_ROWS), ["bucket", "offset", "string"]).filter("least < rank").groupBy("id").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    # A context's answer, once for each row that a task has sent, not for each place.
    answers = C.written(contexts.join(found, "id", "left").filter("first < last OR low IS NOT NULL").select(*context, F.col("first").alias("least"), "low", "high"), "hot-answers")
    answered = rows.join(C.sized(answers, answers.count(), BROADCAST_CONTEXTS), context).select("before", F.octet_length("bytes").alias("size"), "members", "least", "low", "high")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sender's rows hold all anchors of its documents, so what meets in a document is one interval before it leaves the task."""
        held = [np.zeros(0, x) for x in (np.int64, np.int32, np.int64, np.int64)]  # rank, part, a, b
        full = MET
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, counts = _flat(batch.column("members"))
            members = flat.view(_MEMBER)
            row = np.repeat(np.arange(batch.num_rows), counts // _MEMBER.itemsize)
            before, size, least, low, high = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("before", "size", "least", "low", "high"))
            later = members["rank"] > least
            a = np.where(later, np.maximum(0, length - (size - before)), np.nan_to_num(low.astype(float), nan=length))
            b = np.where(later, before, np.nan_to_num(high.astype(float), nan=-1))
            gone = np.flatnonzero(b >= a)
            pos = members["pos"][gone].astype(np.int64)
            new = [members["rank"][gone], members["part"][gone], pos - b[gone].astype(np.int64), pos - a[gone].astype(np.int64) + length]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= full:
                held = met(*held)
                if len(held[0]) >= MET:  # many documents: those that are told are let go
                    yield _told(*held)
                    held = [x[:0] for x in held]
                full = len(held[0]) + MET
        yield _told(*met(*held))

    return answered.mapInArrow(told, _INTERVAL)


def merged_runs(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of rows, ordered by row and start, with those that meet made one."""
    if not len(row):
        return row, a, b
    shift = row * (1 << 40)  # keeps the running end within a row
    end = np.maximum.accumulate(b + shift) - shift
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (a[1:] > end[:-1])])
    at = np.flatnonzero(new)
    return row[at], a[at], end[np.append(at[1:], len(row)) - 1]


def _runs(intervals: DataFrame) -> DataFrame:
    """rank, part and the disjoint runs of each document."""
    grouped = intervals.groupBy("rank", "part").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            row, a, b = merged_runs(row, flat.field("a").to_numpy().astype(np.int64), flat.field("b").to_numpy().astype(np.int64))
            pairs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["a", "b"])
            yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("part"), pa.ListArray.from_arrays(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32), pairs)], ["rank", "part", "runs"])

    return grouped.mapInArrow(work, "rank long, part int, runs array<struct<a:int,b:int>>")


def repeated_runs(docs: DataFrame, length: int = LENGTH, q: int = Q, hot_rows: int = HOT_ROWS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """``docs`` (doc_id, text) with runs (array<struct<a, b>>: the bytes to remove, end exclusive) in place of further columns.

    Ids are integers; others are an error, as "smaller" has to mean one thing for all rows.  A null text counts as empty.  A
    null doc_id is larger than any other.  Rows of one doc_id don't repeat each other.  Texts shorter than ``length`` bytes repeat nothing.  An empty table gives no
    rows."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id is {docs.schema['doc_id'].dataType.simpleString()}: number the documents first")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "sha": F.sha2("text", 256)})
    known = docs.groupBy("sha").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.first(F.octet_length("text")).cast("long").alias("size"))
    known = C.written(known, "texts")
    total = known.agg(F.sum("size")).first()[0] or 0
    copied = known.filter("n > 1").select("sha", "first")
    n_copied = copied.count()
    docs = C.joined(docs, copied, ["sha"], "left", n_copied, BROADCAST_ROWS).withColumn("part", F.hash("sha"))
    copy: Column = F.coalesce(F.col("first") < F.col("rank"), F.lit(False))
    rest = docs.filter(~copy & (F.octet_length("text") >= length)).select("rank", "part", "text")

    n_anchors = max(2, int(total) * 2 // (length - q + 2))
    bits, map_bits = min(60, max(32, n_anchors.bit_length() + 14)), min(bitmap_bits, max(12, n_anchors.bit_length() + 2))
    owners = C.shuffle_partitions(spark)
    if n_anchors <= 2 << bitmap_bits:
        marks = spark.sparkContext.broadcast(_marked(_send(rest, owners, bits, length, q), owners, bits, map_bits, hot_rows))
        cold = _rows(rest, marks, bits, map_bits, False, length, q)
        hot = _rows(rest, marks, bits, map_bits, True, length, q) if len(marks.value[1]) else None
    else:
        cold, hot = _dealt_rows(rest, owners, max(1, int(total) // BLOCK_BYTES), bits, hot_rows, length, q)
    intervals = _cold_intervals(cold, length, q)
    if hot is not None:
        intervals = intervals.unionByName(_hot_intervals(hot, length, q))
    runs = C.written(_runs(intervals), "runs")
    n_runs, n_intervals = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    most = BROADCAST_ROWS if n_intervals <= BROADCAST_INTERVALS else -1
    whole = F.array(F.struct(F.lit(0).alias("a"), F.octet_length("text").cast("int").alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    return C.joined(docs, runs, ["rank", "part"], "left", n_runs, most).select("doc_id", "text", F.when(copy & (F.octet_length("text") >= length), whole).otherwise(F.coalesce("runs", none)).alias("runs"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list]]]:
    for rows, data, bounds in C.chunks(batches):
        raw, runs = data.tobytes(), rows.column("runs").to_pylist()
        kept = []
        for i, own in enumerate(runs):
            at, parts = int(bounds[i]), []
            for r in own:
                parts.append(raw[at:bounds[i] + r["a"]])
                at = int(bounds[i]) + r["b"]
            parts.append(raw[at:bounds[i + 1]])
            kept.append(b"".join(parts))
        yield rows, kept, runs


def substring_report(docs: DataFrame, length: int = LENGTH, q: int = Q, hot_rows: int = HOT_ROWS, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """The digest of :func:`repeated_runs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, kept, runs in _kept(batches):
            removed = np.array([sum(r["b"] - r["a"] for r in own) for own in runs], np.int64)
            yield pa.record_batch({
                "doc_id": rows.column("doc_id"), "n_bytes": pa.array(removed + np.array([len(k) for k in kept], np.int64)), "n_removed": pa.array(removed),
                "n_spans": pa.array([len(own) for own in runs], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            })

    found = repeated_runs(docs, length, q, hot_rows, bitmap_bits)
    return found.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """doc_id and the bytes that stay, as text; a character that a run's end cuts is replaced by U+FFFD."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, kept, _ in _kept(batches):
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "text": pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())})

    return repeated_runs(docs, length, q).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
