"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (``window`` consecutive words, or all of a shorter item) are sets of word
shingles.  Shingles are ordered by how often the documents have them.  A document holds a window
only if it holds the window's whole set, so with a containment of 1 one prefix token is necessary:
the window's rarest shingle.  Documents probe with their shingles, positional and length bounds
leave places where the window has room, and the words there are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
SHINGLE = 5
#: Bits of the fixed-size bitmaps that keep shingles of no item from leaving the scan (2 MB).
BITMAP_BITS = 24
#: Windows up to which the probe's side is broadcast (a window is some hundred bytes).
BROADCAST_ROWS = 50_000


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, the words' starts, ends and hashes, and the rows' bounds in them."""
    data = C.lowered(data)
    starts, ends, firsts = C.word_spans(data, bounds, C.WORD_BYTES)
    return data, starts, ends, C.span_hashes(C.prefix_sums(data), starts, ends), firsts


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The distinct windows of ``items`` (item_id, text): words (space-joined), n_words, shingles
    (hashes, in order), items (ids as strings; a null id is 'null')."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            data, starts, ends, hashes, firsts = _words(data, bounds)
            text = C.strings(data, starts, ends)
            names, found, counts, sets = rows.column("item").to_pylist(), [], [], []
            owner = []
            for i, name in enumerate(names):
                a, b = int(firsts[i]), int(firsts[i + 1])
                size = min(window, b - a)
                for at in range(a, b - size + 1) if size else ():
                    k = min(shingle, size)
                    own, _ = C.shingle_hashes(hashes[at:at + size], np.array([0, size]), k)
                    owner.append(name)
                    found.append(" ".join(text[at:at + size]))
                    counts.append(size)
                    sets.append(own.astype(np.int64).tolist())
            yield pa.record_batch({"item": pa.array(owner, pa.string()), "words": pa.array(found, pa.string()), "n": pa.array(counts, pa.int32()), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    cuts = named.mapInArrow(cut, "item string, words string, n int, shingles array<long>")
    return cuts.groupBy("words").agg(F.first("n").alias("n_words"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits.  Rows that share a doc_id, or have none, are
    judged each for itself.  Items without words match nothing; items with equal words are all
    counted.  Empty tables give no rows, or no hits.  Further columns are ignored."""
    windows = C.written(item_windows(items, window, shingle), "windows")
    sizes = [x[0] for x in windows.select(F.least("n_words", F.lit(shingle))).distinct().collect()]  # at most `shingle` values
    exploded = windows.select("words", F.posexplode("shingles").alias("offset", "hash"))
    docs = docs.select("doc_id", "text")

    wanted = docs.sparkSession.sparkContext.broadcast(C.bitmap(exploded, "hash", BITMAP_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in C.chunks(batches):
            _, _, _, hashes, firsts = _words(data, bounds)
            hits = [h[C.in_bitmap(wanted.value, BITMAP_BITS, h)] for k in sizes for h, _ in [C.shingle_hashes(hashes, firsts, k)]]
            values, counts = np.unique(np.concatenate([*hits, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.record_batch({"hash": pa.array(values.astype(np.int64)), "n": pa.array(counts.astype(np.int64))})

    rarity = docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    # The prefix: each window's rarest shingle.  A window with a shingle that no document has can't occur.
    prefix = (
        exploded.join(rarity, "hash", "left").groupBy("words")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("hash"), F.col("offset"))).alias("rarest")).filter("rarest.n > 0")
        .join(windows, "words").select("rarest.hash", "rarest.offset", "words", "n_words", "items")
    )
    prefix = C.written(prefix, "prefix")
    n_prefix = prefix.count()
    probing = docs.sparkSession.sparkContext.broadcast(C.bitmap(prefix, "hash", BITMAP_BITS))
    reach = max(1, window)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row its words' number and the shingles that may be prefixes, each with the words around it."""
        for rows, data, bounds in C.chunks(batches):
            data, starts, ends, hashes, firsts = _words(data, bounds)
            found, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for k in sizes:
                h, first = C.shingle_hashes(hashes, firsts, k)
                keep = C.in_bitmap(probing.value, BITMAP_BITS, h)
                found.append(h[keep])
                at.append(first[keep])
            found, at = np.concatenate(found), np.concatenate(at)
            order = np.argsort(at, kind="stable")
            found, at = found[order], at[order]
            row = np.searchsorted(firsts, at, "right") - 1
            low, high = np.maximum(firsts[row], at - reach), np.minimum(firsts[row + 1], at + reach)
            raw, around = data.tobytes(), []
            first_byte, last_byte = starts.tolist(), ends.tolist()
            for a, b in zip(low.tolist(), high.tolist()):
                around.append(" ".join(raw[first_byte[w]:last_byte[w]].decode() for w in range(a, b)))
            hits = pa.StructArray.from_arrays(
                [pa.array(found.astype(np.int64)), pa.array((at - firsts[row]).astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(around, pa.string())],
                ["hash", "at", "before", "around"],
            )
            cuts = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
            yield pa.record_batch({"row": rows.column("row"), "doc_id": rows.column("doc_id"), "n_words": pa.array(np.diff(firsts).astype(np.int64)), "hits": pa.ListArray.from_arrays(cuts, hits)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    probed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        probe, f"row long, doc_id {id_type}, n_words long, hits array<struct<hash:bigint,at:int,before:int,around:string>>"
    )
    candidates = probed.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select("row", "doc_id", "n_words", F.col("hit.hash").alias("hash"), "hit")
    start = F.col("hit.before") - F.col("offset")  # positional bound: the window's first word among those around
    words = F.split("hit.around", " ")
    room = (start >= 0) & (F.size(words) >= start + F.col("n_words_w"))  # and length bound
    same = F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.col("n_words_w")), " ") == F.col("words")
    begin = F.col("hit.at") - F.col("offset")
    found = F.when(room & same, F.struct(begin.alias("a"), (begin + F.col("n_words_w")).alias("b"), F.col("items")))
    per_row = (
        candidates.join(C.sized(prefix.withColumnRenamed("n_words", "n_words_w"), n_prefix, broadcast_rows), "hash", "left")
        .groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(found)).alias("spans"))
    )
    # Words under any of the spans, which stand in order: each adds what lies beyond those before it.
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).alias("end"),
            (acc["n"] + F.greatest(x["b"] - F.greatest(acc["end"], x["a"]), F.lit(0))).alias("n"),
        ),
    )["n"]
    item_set = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: x["items"]))))
    return per_row.select("doc_id", "n_words", covered.alias("n_hit"), item_set.alias("found")).select(
        "doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns.  A row's own text decides, whatever its doc_id is
    and which others have it; null and empty texts stay."""
    known = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_id"), "text")
    hit = C.written(contamination(known, items).filter("contaminated").select(F.col("doc_id").alias("_sha")).distinct(), "contaminated")
    rows = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    return C.joined(rows, hit, ["_sha"], "left_anti", hit.count(), broadcast_rows).select(*docs.columns)
