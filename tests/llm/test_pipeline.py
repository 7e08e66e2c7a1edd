"""The pipeline against plain Python over small documents, and the operators' SQL."""

import duckdb
import pytest

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_copies import brute as brute_kept
from tidemill.llm.queries import QUERIES, SQL
from tidemill.llm.quality import quality_report

DATA = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    good = {r.doc_id for r in quality_report(docs, labels).filter("predicted = 1").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    largest = {}
    for d, t in left.items():
        largest[t] = max(d, largest.get(t, d))
    left = {d: t for t, d in largest.items()}
    left = {d: left[d] for d in brute_kept(sorted(left.items()))}
    hit = {x[0] for x in brute_hits(sorted(left.items()), [(r.item_id, r.text) for r in items.collect()]) if x[5]}
    want = sorted(set(left) - hit)
    out = P.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == want and all(r.round_trip for r in out)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "tokens"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
