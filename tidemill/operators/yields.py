"""Yield fields that don't agree: what to write, how often, and with what success."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import plain_fractions, quantity_in, yield_action, yield_number_in


def told(records: DataFrame, text: str) -> DataFrame:
    """``records`` with told, the number that the yield text tells.  Each step is a column of its own, so that none is computed for each of
    the patterns that look at it."""
    plain = records.withColumn("_plain", plain_fractions(F.trim(F.coalesce(text, F.lit("")))))
    plain = plain.withColumn("_first", quantity_in(F.col("_plain")))
    return plain.withColumn("told", yield_number_in(F.col("_plain"), F.col("_first"))).drop("_plain", "_first")


def planned(records: DataFrame, key: str, text: str, amount: str, servings: str) -> DataFrame:
    """key, action, new_text, new_number of the records whose yield fields don't agree."""
    rows = told(records, text)
    return rows.select(key, yield_action(F.col(text), F.col(amount), F.col(servings), F.col("told")).alias("a")).filter("a IS NOT NULL").select(key, "a.*")


def unreadable(records: DataFrame, key: str, text: str, amount: str, servings: str) -> DataFrame:
    """key and text of the records with a text that tells no number, and no number beside it."""
    rows = told(records, text).filter((F.trim(F.coalesce(text, F.lit(""))) != "") & F.col("told").isNull())
    return rows.filter((F.coalesce(amount, F.lit(0.0)) == 0) & (F.coalesce(servings, F.lit(0.0)) == 0)).select(key, text)


def action_counts(plan: DataFrame) -> DataFrame:
    """action and n, for each of the three actions."""
    every = plan.sparkSession.createDataFrame([("set_servings",), ("set_text",), ("sync_qty",)], "action string")
    return every.join(plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")), "action", "left").fillna(0, ["n"])


def applied(records: DataFrame, plan: DataFrame, key: str, text: str, amount: str, servings: str) -> DataFrame:
    """``records`` with the plan's texts and numbers: set_text and set_servings write both fields, sync_qty the amount."""
    joined = records.join(plan, key, "left")
    number = F.col("new_number")
    new = {
        text: F.when(F.col("action") == "set_text", F.col("new_text")).otherwise(F.col(text)),
        amount: F.when(F.col("action").isNotNull(), number).otherwise(F.col(amount)),
        servings: F.when(F.col("action").isin("set_text", "set_servings"), number).otherwise(F.col(servings)),
    }
    return joined.withColumns(new).select(*records.columns)


def outcome(plan: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """applied and failed: how many actions have a record to act on, and how many have none."""
    known = before.select(key, F.lit(1).alias("known")).distinct()
    return plan.join(known, key, "left").agg(F.count_if(F.col("known").isNotNull()).alias("applied"), F.count_if(F.col("known").isNull()).alias("failed"))
