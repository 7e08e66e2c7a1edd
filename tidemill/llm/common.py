"""Helpers shared by the operators: scratch tables, Arrow batches as byte arrays,
vectorised word splitting and hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written  # noqa: F401  the operators' scratch tables

#: Bytes of text that are turned into arrays at once in a task.
CHUNK_BYTES = 1 << 20

# Odd multipliers of the polynomial hashes (golden-ratio and splitmix style constants).
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def sized(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for a broadcast if its counted ``rows`` are within ``most``, else as it is,
    for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Arrow batches as byte arrays -----------------------------------------

def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``limit`` bytes of text, one row at least: the rows, their
    texts' UTF-8 bytes end to end, and the rows' bounds in them.  A null text has no bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        if col.null_count:
            col = pc.fill_null(col, "")
        bounds = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
            to = min(max(to, at + 1), len(col))
            yield batch.slice(at, to - at), data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
            at = to
        del batch, col, bounds, data
        pa.default_memory_pool().release_unused()  # an executor's workers share its memory


def class_table(chars: bytes, high: bool) -> np.ndarray:
    """A table of the bytes in ``chars``, and of all that belong to characters from U+0080 on if ``high``."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    table[128:] = high
    return table


#: Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: digits, a-z, and everything from U+0080 on.
WORD_BYTES = class_table(b"0123456789abcdefghijklmnopqrstuvwxyz", True)
#: Bytes of ``[^\\x20\\x09-\\x0D]``.
SOLID_BYTES = ~class_table(b" \t\n\x0b\x0c\r", False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table``'s bytes, none across rows, and each row's
    bounds in the list of runs."""
    inside = table[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    full = np.flatnonzero(np.diff(bounds))
    before[bounds[:-1][full]] = False
    after[bounds[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


# --- hashing ----------------------------------------------------------------

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    if len(_powers.get("p", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for key, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["p"], _powers["q"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * P**position, from which any substring's polynomial hash follows."""
    powers, _ = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings, equal for equal bytes wherever they stand."""
    _, inverse = _power_tables(len(sums) - 1)
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words of a row, and the first word of each, as indexes of ``words``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = words[:n].copy()
    for j in range(1, k):
        total = total * _Q + words[j:n + j]
    room = np.repeat(firsts[1:], np.diff(firsts))[:n]  # where the row of each word ends
    at = np.flatnonzero(np.arange(n) + k <= room)
    return mixed(total[at] + np.uint64(k)), at


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]


# --- fixed-size bitmaps -----------------------------------------------------

def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with a bit set for the top bits of each hash.  Its size doesn't
    depend on the data, so it may be broadcast; executors OR their parts before the shuffle."""
    slots = hashes.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("slot"))
    rows = (
        slots.selectExpr("shiftrightunsigned(slot, 6) AS at", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
        .groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool) if bits <= 24 else words.view(np.uint8)


def in_bitmap(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Of each hash, whether its bit of a table made by :func:`bitmap` is set."""
    slot = hashes >> np.uint64(64 - bits)
    if table.dtype == bool:
        return table[slot]
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: log2 of the most bits of the bitmap that a large join's rows pass first: 32 MB.
SIEVE_BITS = 28


def sieve(right: DataFrame, on: Sequence[str], n: int) -> Callable[[DataFrame], Column]:
    """For rows with the columns ``on``: may they be among the ``n`` of ``right``?  Never no for one that is; ``right`` is read once.
    Its bitmap is of a size that doesn't grow beyond ``SIEVE_BITS``; with more rows than that serves, more of the others pass."""
    bits = min(SIEVE_BITS, max(16, n.bit_length() + 5))
    table = right.sparkSession.sparkContext.broadcast(bitmap(right.select(F.xxhash64(*on).alias("h")), "h", bits))

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(table.value, bits, h.to_numpy().view(np.uint64)))

    return lambda rows: passes(F.xxhash64(*(rows[c] for c in on)))


def joined(rows: DataFrame, right: DataFrame, on: Sequence[str], how: str, n: int, most: int) -> DataFrame:
    """``rows`` joined (left, left_semi, left_anti) with the ``n`` rows of ``right`` on columns of one name, where null equals null.

    Up to ``most`` rows are broadcast.  Beyond, only rows that pass :func:`sieve` are shuffled, and the others, for which
    nothing can be found, stay where they are; so ``right``, which is read twice, has to be a written table."""
    keys = {c: f"_r{i}" for i, c in enumerate(on)}
    kinds = {f.name: f.dataType for f in right.schema.fields if f.name not in keys}
    renamed = right.withColumnsRenamed(keys)

    def found(some: DataFrame, other: DataFrame) -> DataFrame:
        return some.join(other, reduce(Column.__and__, (some[c].eqNullSafe(other[k]) for c, k in keys.items())), how).drop(*keys.values())

    if n <= most:
        return found(rows, F.broadcast(renamed))
    may = sieve(right, on, n)
    inside = found(rows.filter(may(rows)), renamed)
    if how == "left_semi":
        return inside
    outside = rows.filter(~may(rows))
    if how == "left":
        outside = outside.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    return inside.unionByName(outside)
