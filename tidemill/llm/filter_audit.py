"""What five filters remove, alone and after each other, as a relational word pipeline.

Words are exploded and counted by (document, word) and then by document, which gives totals and distinct words.
Flags of the other filters are joined to that, each document becomes one of 32 combinations of failures, and a part of the
corpus is 32 conditional counts.  Every order of the filters is arithmetic on these counts.

A document is known by its id and a hash of its text; rows that repeat both are one with a number.  The earliest
copy of a text joins by text and id, so that the copies of one text are spread over all tasks, however many they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
#: A: fewest words.  B: distinct words in percent, at least.  C: capitals in percent of characters, at most.  D: signs that fail.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 3, "#$%&*|"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), words and distinct: of every text that has words, its words and how many differ.

    Rows that repeat an id with its text give one row, and are one before the shuffle; of null ids each text gives one.
    Texts are dealt by the document's key once; both groupings keep that partitioning, so that words are not shuffled."""
    texts = _keyed(docs).groupBy("doc_id", "h").agg(F.any_value("text").alias("text"))
    words = texts.select("doc_id", "h", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word != ''")
    by_word = words.groupBy("doc_id", "h", "word").agg(F.count(F.lit(1)).alias("n"))
    return by_word.groupBy("doc_id", "h").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of equal id, text and part as one: doc_id, part, rows (how many they are), mask (bit 0 for A to bit 4 for E),
    good and toxic (as labelled, else false)."""
    rows = _keyed(docs).groupBy("doc_id", "h", "part", F.unhex(F.sha2("text", 256)).alias("sha"), _capitals(F.col("text")).alias("c"), _any_sign(F.col("text")).alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    rows = written(rows, "audited")
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    totals = word_totals(docs).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    # Null ids match no label and no first copy; a second key deals them out.
    spread = F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(F.lit(0).cast("long"))
    found = (
        rows.join(totals, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").drop("_id", "_h")
        .withColumn("spread", spread)
        .join(firsts.withColumn("spread", F.lit(0).cast("long")), ["sha", "doc_id", "spread"], "left")
        .join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    )
    words, distinct = F.coalesce("words", F.lit(0).cast("long")), F.coalesce("distinct", F.lit(0).cast("long"))
    failed = {"A": words < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT * words, "C": F.col("c"), "D": F.col("d"), "E": F.col("doc_id").isNotNull() & F.col("first").isNull()}
    mask = sum((F.when(failed[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    return found.select("doc_id", "part", "rows", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _capitals(text: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MAX_CAPITALS * F.length(text)


def _any_sign(text: Column) -> Column:
    return reduce(Column.__or__, (text.contains(c) for c in SIGNS))


def combination_counts(failed: DataFrame) -> DataFrame:
    """part, and arrays of 32 conditional counts by mask: n of all documents, good and toxic of those so labelled."""
    one = failed.groupBy("part", "mask").agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("rows")).otherwise(0)).alias("toxic"))
    masks = range(1 << len(FILTERS))
    return one.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(k))), F.lit(0).cast("long")) for m in masks)).alias(k) for k in ("n", "good", "toxic")))


def orders(counts: DataFrame) -> DataFrame:
    """Of each part every order of the filters, a row a step, from the counts of :func:`combination_counts`."""
    letters = F.array(*map(F.lit, FILTERS))
    every = counts.withColumn("filter_order", F.lit(""))
    for _ in FILTERS:
        longer = F.transform(F.filter(letters, lambda x: ~F.col("filter_order").contains(x)), lambda x: F.concat("filter_order", x))
        every = every.withColumn("filter_order", F.explode(longer))
    step = F.col("step")
    every = every.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    every = every.withColumn("name", F.expr("substr(filter_order, step, 1)")).withColumn("earlier", F.expr("substr(filter_order, 1, step - 1)"))
    bits = lambda name: sum((F.when(F.col(name).contains(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    every = every.withColumn("bit", bits("name")).withColumn("prior", bits("earlier"))

    def total(kind: str, holds) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(holds(m.bitwiseAND(F.col("prior")) == 0, m.bitwiseAND(F.col("bit")) != 0), F.col(kind)[m]).otherwise(F.lit(0).cast("long")))

    here = lambda new, fails: new & fails
    every = every.select(
        "part", "filter_order", step, "name",
        total("n", lambda new, fails: new & ~fails).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda new, fails: ~new & fails).alias("redundant"),
        F.col("n")[F.col("bit")].alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    shares = every.groupBy("part", "name").agg(F.sum("removed").alias("shapley"))
    return every.join(shares, ["part", "name"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: of every lang of
    ``docs`` (doc_id, text, lang) all 120 orders of the filters, a row a step, zeros included.

    A null text counts as empty, a null lang is the part ''.  Every row is a document, repeated rows too.  A row without a
    doc_id is neither an earlier copy nor a later one.  Of labels that repeat a doc_id one that says 1 is enough; null labels
    say nothing.  An empty table gives no rows; further columns are ignored."""
    return orders(combination_counts(failures(docs, labels)))
