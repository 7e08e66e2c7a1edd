"""Every query with SQL gives the same rows in DuckDB; the others run."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemill.queries import QUERIES, SQL

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in SQL:
        found = duck.sql(SQL[name])
        at = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == columns
        assert ordered(got) == ordered(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_folded_keys(spark):
    """Without SQL: against Python's own folding of every document's first line."""
    import unicodedata

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {d: " ".join(unicodedata.normalize("NFKC", (t or "").split("\n")[0]).casefold().split()) for d, t in docs.items()}
    assert {r.doc_id: r.key for r in QUERIES["folded_keys"](spark, DATA).collect()} == want
