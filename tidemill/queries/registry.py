"""Where queries and their SQL are kept, and the tables seen as records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import link_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: their links are the parts, suppliers and return flags of their lines."""
    orders, lines = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    links = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    return link_counts(orders, "o_orderkey", {"n_parts": (links, "l_partkey"), "n_suppliers": (links, "l_suppkey"), "n_flags": (links, "l_returnflag")})


def checks() -> dict:
    """The six dimensions of a record's completeness."""
    return {
        "category": F.col("n_flags") > 0, "tags": F.col("n_parts") >= 3, "tools": F.col("n_suppliers") >= 2,
        "description": F.col("o_orderpriority") != "4-NOT SPECIFIED", "time": F.col("o_orderstatus") != "O", "yield": F.col("o_totalprice") > 100000,
    }


#: The same as common table expressions: counted, then held (a boolean each), then scored.
SCORED = """
    WITH counted AS (
        SELECT o.*, coalesce(n_parts, 0) AS n_parts, coalesce(n_suppliers, 0) AS n_suppliers, coalesce(n_flags, 0) AS n_flags
        FROM orders o LEFT JOIN (
            SELECT l_orderkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_returnflag) AS n_flags
            FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey),
    held AS (
        SELECT *, n_flags > 0 AS c1, n_parts >= 3 AS c2, n_suppliers >= 2 AS c3, o_orderpriority <> '4-NOT SPECIFIED' AS c4, o_orderstatus <> 'O' AS c5, o_totalprice > 100000 AS c6
        FROM counted),
    scored AS (
        SELECT *, CAST(c1 AS INT) + CAST(c2 AS INT) + CAST(c3 AS INT) + CAST(c4 AS INT) + CAST(c5 AS INT) + CAST(c6 AS INT) AS score FROM held)
"""
TIER = "CASE WHEN score >= 5 THEN 'gold' WHEN score >= 3 THEN 'silver' ELSE 'bronze' END"
