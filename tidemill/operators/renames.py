"""Renames one after another, where each may free the name that a later one wants.

A name that no record has goes to the first record that wants it.  A name that a record is to give up goes to the first that
wants it after that record's turn, if the record's own rename came about.  So each rename waits for at most one other, an
earlier one, and whether a whole chain of them comes about is told by pointer doubling: in every round each waiting
rename learns what the one it waits for knows, or waits for what that one waits for.  Cycles don't wait: the first
of one has its turn while its name is still taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Records that want one name from which on they are dealt over SALTS keys.
HOT, SALTS = 10_000, 64


def in_turn(records: DataFrame, key: str, order: str, name: str, wanted: str) -> DataFrame:
    """The records whose ``name`` isn't the ``wanted`` one, with what becomes of them when all have their turn in ``order`` (then by
    ``key``): key, old_name, new_name, action (rename, or conflict if the name is taken at that time) and frees (does the rename
    wait for another to free its name?).

    Keys are unique; records without a key, or to which an empty or null name is wanted or given, are left alone, but their name
    is taken.  A name that several records have stays taken."""
    wrong = records.filter(F.col(key).isNotNull() & (F.col(wanted) != "") & (F.col(name) != "") & (F.col(wanted) != F.col(name)))
    wrong = written(wrong.select(F.col(key).alias("key"), F.struct(F.col(order).alias("a"), F.col(key).alias("b")).alias("turn"), F.col(name).alias("old"), F.col(wanted).alias("new")), "renames")
    held = records.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("new")).agg(F.count(F.lit(1)).alias("holders"))
    leaves = wrong.select(F.col("old").alias("new"), F.col("key").alias("holder"), F.col("turn").alias("left"))
    # Of a name with one holder, who it is and when it leaves; of one with several it doesn't matter.
    held = held.join(leaves.groupBy("new").agg(F.min(F.struct("left", "holder")).alias("first")), "new", "left")
    hot = F.broadcast(wrong.groupBy("new").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("new", F.lit(True).alias("hot")))
    dealt = wrong.join(hot, "new", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    told = held.join(hot, "new", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    free = F.col("holders").isNull()
    later = (F.col("holders") == 1) & (F.col("first.left") < F.col("turn"))
    asked = dealt.join(told, ["new", "salt"], "left").filter(free | later).select("key", "new", "turn", F.when(later, F.col("first.holder")).alias("waits"))
    # The first of those who may have a name, found by a minimum and not by a join back on the name.
    first = asked.groupBy("new").agg(F.min(F.struct("turn", "key", "waits")).alias("w")).select("w.key", "w.waits")
    state = written(first.select("key", "waits", F.when(F.col("waits").isNull(), F.lit(True)).alias("done"), F.col("waits").isNotNull().alias("frees")), "turns")
    while state.filter("done IS NULL").limit(1).count():
        ahead = state.select(F.col("key").alias("waits"), F.col("done").alias("then"), F.col("waits").alias("further"), F.lit(True).alias("known"))
        open_ = state.filter("done IS NULL").join(ahead, "waits", "left")
        # One that isn't among the first has no rename.
        moved = open_.select("key", F.when(F.col("then").isNull() & F.col("known"), F.col("further")).alias("waits"), F.when(F.col("known"), F.col("then")).otherwise(F.lit(False)).alias("done"), "frees")
        state = written(state.filter("done IS NOT NULL").unionByName(moved), "turns")
    told_all = wrong.join(state.select("key", "done", "frees"), "key", "left")
    done = F.coalesce("done", F.lit(False))
    return told_all.select("key", F.col("old").alias("old_name"), F.col("new").alias("new_name"), F.when(done, "rename").otherwise("conflict").alias("action"), (done & F.coalesce("frees", F.lit(False))).alias("frees")).withColumnRenamed("key", key)


def rename_counts(told: DataFrame) -> DataFrame:
    """applied and skipped: how many of :func:`in_turn` come about, and how many don't."""
    return told.agg(F.count_if(F.col("action") == "rename").alias("applied"), F.count_if(F.col("action") == "conflict").alias("skipped"))
