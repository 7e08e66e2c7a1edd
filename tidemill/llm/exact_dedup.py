"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Documents are dealt to senders by their id and text.  A sender sorts short fingerprints of its texts, cuts
them by owner and sends each owner one Golomb-Rice coded list; the owner answers with one bit for
each value: does it occur more than once?  Only texts whose bit is set are then shuffled, and
compared byte for byte by grouping on the text itself.  Equal texts collapse to one row in every
map task first, so that a text that fills a third of the corpus costs one row a task.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, shuffle_partitions, written

#: Bits of a fingerprint beyond log2 of the number of documents: a unique text is a suspect with a chance of about 2**-SLACK.
SLACK = 10
#: Rows up to which suspects or groups are broadcast; with more of them rows pass a bitmap of fixed size first, and what passes is shuffled.
BROADCAST_ROWS = 500_000


def golomb_encode(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as gaps: quotients in unary, then remainders of k bits each."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(gaps.mean()).bit_length() - 1) if len(gaps) else 0
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    unary[ones] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
    first = np.packbits(unary).tobytes()
    return struct.pack("<IBI", len(values), k, len(first)) + first + np.packbits(rest.reshape(-1)).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    """What :func:`golomb_encode` was given."""
    n, k, length = struct.unpack_from("<IBI", code)
    at = struct.calcsize("<IBI")
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, length, at)))[:n]
    quotients = (np.diff(ones, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=at + length))[: n * k].reshape(n, k).astype(np.uint64)
    rest = (bits << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((quotients << np.uint64(k)) + rest, dtype=np.uint64)


def _sender_lists(prints: pa.Table, owners: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sender's distinct fingerprints in order, whether it has each several times, and where each owner's begin."""
    values = prints.column("fp").to_numpy().astype(np.uint64)
    order = np.argsort(values)
    cuts = (np.arange(owners + 1, dtype=object) * (1 << bits) + owners - 1) // owners
    return values[order], prints.column("several").to_numpy()[order], np.searchsorted(values[order], np.array([min(int(c), 2**63 - 1) for c in cuts], np.uint64))


def copied_texts(docs: DataFrame, slack: int = SLACK, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """The texts that several rows have: text_sha256, keep_id, group_size; and how many they are, at most."""
    spark = docs.sparkSession
    owners = shuffle_partitions(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bits = min(62, max(12, int(docs.count()).bit_length() + slack))
    fp = F.shiftrightunsigned(F.xxhash64("text"), 64 - bits)
    # Repeated ids, or none, don't meet in one sender, and equal texts of one sender are one row before the shuffle.
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", fp), F.lit(owners)).cast("int").alias("sender"), fp.alias("fp"))
    dealt = dealt.groupBy("sender", "fp").agg((F.count(F.lit(1)) > 1).alias("several"))

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, several, cuts = _sender_lists(table, owners, bits)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "owner": pa.array(full, pa.int32()),
            "sender": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "code": pa.array([golomb_encode(values[cuts[o]:cuts[o + 1]]) for o in full], pa.binary()),
            "several": pa.array([np.packbits(several[cuts[o]:cuts[o + 1]]).tobytes() for o in full], pa.binary()),
        })

    def own(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = [golomb_decode(c) for c in table.column("code").to_pylist()]
        values, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        repeated = counts > 1
        ends = np.cumsum([len(x) for x in lists])
        several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: len(x)] for b, x in zip(table.column("several").to_pylist(), lists)])
        np.logical_or.at(repeated, back[several > 0], True)
        marks = [np.packbits(m).tobytes() for m in np.split(repeated[back], ends[:-1])]
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "marks": pa.array(marks, pa.binary())})

    def heed(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        values, _, cuts = _sender_lists(left, owners, bits)
        marked = np.zeros(len(values), bool)
        for owner, marks in zip(right.column("owner").to_pylist(), right.column("marks").to_pylist()):
            marked[cuts[owner]:cuts[owner + 1]] = np.unpackbits(np.frombuffer(marks, np.uint8))[: cuts[owner + 1] - cuts[owner]]
        return pa.table({"fp": pa.array(values[marked].astype(np.int64), pa.int64())})

    sent = dealt.groupBy("sender").applyInArrow(send, "owner int, sender int, code binary, several binary")
    answers = sent.groupBy("owner").applyInArrow(own, "sender int, owner int, marks binary")
    suspects = written(
        dealt.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(heed, "fp long").distinct(), "suspects"
    )
    n = suspects.count()
    # Byte verification: the grouping key is the text itself.
    groups = (
        joined(docs.withColumn("fp", fp), suspects, ["fp"], "left_semi", n, broadcast_rows)
        .groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return (groups if n <= broadcast_rows else written(groups, "copied-texts")), n


def exact_duplicates(docs: DataFrame, slack: int = SLACK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are.  A null text counts as empty, so null and empty texts
    form one group.  Of a group the row with the largest doc_id stays; a null doc_id is below any
    other, and rows that repeat the largest doc_id of their group are all marked as kept.  An empty
    table gives no rows; further columns are ignored."""
    groups, n = copied_texts(docs, slack, broadcast_rows)
    members = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return joined(members, groups, ["text_sha256"], "left", n, broadcast_rows).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Each row is judged by its own text and doc_id: rows of one doc_id with different texts are judged
    each for itself, and of rows that tie for the largest doc_id of a text all stay, without a doc_id too."""
    groups, n = copied_texts(docs, broadcast_rows=broadcast_rows)
    groups = groups.select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"), F.lit(True).alias("_several"))
    rows = joined(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), groups, ["_sha"], "left", n, broadcast_rows)
    return rows.filter(F.col("_several").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))).select(*docs.columns)
