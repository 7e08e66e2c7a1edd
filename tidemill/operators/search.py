"""Search for texts anywhere in columns, by an inverted index of character trigrams.

The index is two written tables: which records hold each trigram, in order of the trigrams, cut into blocks of records; and
the records' texts in order of their keys.  A block is what a task turns into lists at once, so that a trigram leaves it with
its records and not once for each of them, and no list has to be gathered.  A question reads the lists of its rarest trigrams,
intersects them block by block, and looks into the texts of the records that are left.  What it reads is bounded by
its rarest trigram, not by the table; a question of fewer than three characters reads all texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Records and bytes of text of a block at most (a longer text is a block of its own), trigrams of a question that are looked up, and keys up
#: to which texts are read by them alone.
BLOCK, BYTES, LOOKED_UP, KEYS = 50_000, 4 << 20, 4, 2000
#: Lists that leave a task at once.
SENT = 4_000


def said(columns: Sequence[str]) -> Column:
    """What is searched: the columns in lower case, with spaces between."""
    return F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))


def trigrams(text: str) -> set[str]:
    return {text[i:i + 3] for i in range(len(text) - 2)}


def build(rows: DataFrame, key: str, columns: Sequence[str], path: str) -> None:
    """Writes the index of ``rows`` at ``path``.  Keys are unique and not null; rows without one are left out, as nothing could name them."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    texts = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), said(columns).alias("text"))
    texts.repartitionByRange(F.col("key")).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/texts")

    most, size = BLOCK, BYTES

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _blocks(batches, most, size):
            words, bounds, rows = posting_lists(texts)
            name = uuid4().hex
            for i in range(0, len(words), SENT):
                cuts = bounds[i:i + SENT + 1]
                own = keys.take(pa.array(rows[cuts[0]:cuts[-1]]))
                lists = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), own)
                n = len(lists)
                yield pa.RecordBatch.from_arrays([pa.array(words[i:i + n], pa.string()), pa.array([name] * n), lists, pa.array(np.diff(cuts).astype(np.int32))], ["gram", "block", "keys", "n"])

    kept = spark.read.parquet(f"{path}/texts")
    lists = written(kept.mapInArrow(grams, f"gram string, block string, keys array<{kind}>, n int"), "lists")  # the order is sampled, which would make them twice
    lists.repartitionByRange(F.col("gram"), F.col("block")).sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/lists")


def _blocks(batches: Iterator[pa.RecordBatch], most: int, limit: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of a block after another."""
    keys: list[pa.Array] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(sizes[at:]), limit - size, "right"))
            n = max(min(n, most - len(texts), batch.num_rows - at), 0 if texts else 1)
            keys.append(batch.column(0).slice(at, n))
            texts += [x or "" for x in batch.column(1).slice(at, n).to_pylist()]
            size, at = size + int(sizes[at:at + n].sum()), at + n
            if at < batch.num_rows or size >= limit or len(texts) >= most:
                yield pa.concat_arrays(keys), texts
                keys, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(keys), texts


def posting_lists(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The trigrams of texts, and for each of them between two bounds the numbers of the texts that hold it."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(text[2:] == text[:-2]) if len(chars) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return [], np.zeros(1, np.int64), at
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    number = np.cumsum(seen) - 1
    c = number[chars]
    n = len(alphabet)
    gram = (c[at] * n + c[at + 1]) * n + c[at + 2]  # of 1.1 million characters at most, so below 2 ** 61
    if n ** 3 * len(texts) < 1 << 62:
        both = np.unique(gram * len(texts) + text[at])
        gram, row = both // len(texts), both % len(texts)
    else:
        order = np.lexsort((text[at], gram))
        gram, row = gram[order], text[at][order]
        once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])
        gram, row = gram[once], row[once]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    g = gram[first]
    said = alphabet[np.stack([g // (n * n), g // n % n, g % n], 1)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [said[i:i + 3] for i in range(0, len(said), 3)], np.append(first, len(gram)), row


def found(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The keys of the records in which the text stands, whatever its case; white space around it doesn't count, and no text is in all."""
    texts = spark.read.parquet(f"{path}/texts")
    wanted = spark.range(1).select(F.lower(F.lit(text.strip()))).first()[0]
    holds = F.contains(F.col("text"), F.lit(wanted))
    grams = sorted(trigrams(wanted))
    if not grams:
        return texts.filter(holds).select("key")
    lists = spark.read.parquet(f"{path}/lists").filter(F.col("gram").isin(grams))
    sizes = {r["gram"]: r["n"] for r in lists.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # as many as the question has
    if len(sizes) < len(grams):  # one of them is nowhere
        return texts.limit(0).select("key")
    rare = sorted(grams, key=lambda g: (sizes[g], g))[:LOOKED_UP]
    own = lists.filter(F.col("gram").isin(rare)).groupBy("block").agg(F.collect_list("keys").alias("lists"))
    shared = own.filter(F.size("lists") == len(rare)).select(F.explode(F.aggregate(F.slice("lists", 2, len(rare)), F.get("lists", F.lit(0)), F.array_intersect)).alias("key"))
    keys = [r["key"] for r in shared.limit(KEYS + 1).collect()]
    if len(keys) <= KEYS:
        return texts.filter(F.col("key").isin(keys) & holds).select("key")
    return texts.join(shared, "key", "left_semi").filter(holds).select("key")


def of_origin(runs: DataFrame, schedule: str, origin: str = "all") -> DataFrame:
    """The runs that were scheduled (they have a schedule), or that were made by hand; all for any other origin."""
    has = F.coalesce(F.col(schedule).cast("string") != "", F.lit(False))
    return runs.filter(has) if origin == "scheduled" else runs.filter(~has) if origin == "manual" else runs
