import itertools
import random
import re

import duckdb
import pytest

from tidemill.llm import filter_audit as A
from tidemill.llm.queries import SQL, op13_filter_audit

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """part -> order -> step -> the seven numbers, one document after the other."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    parts = {}
    for i, t, lang in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > ids[text],
        }
        parts.setdefault(lang or "", []).append((i, {f for f in fails if fails[f]}))
    found = {}
    for part, members in parts.items():
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                prior = set(order[:k])
                here = [i for i, bad in members if f in bad and not bad & prior]
                share[f] += len(here)
                found[part, "".join(order), k + 1] = [
                    sum(not bad & (prior | {f}) for _, bad in members), len(here), sum(f in bad and bool(bad & prior) for _, bad in members),
                    sum(bad == {f} for _, bad in members), sum(i in good for i in here), sum(i in toxic for i in here),
                ]
        for (p, order, k), row in found.items():
            if p == part:
                row.append(share[order[k - 1]])
    return {k: tuple(v) for k, v in found.items()}


def rows(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "A", "word", "a # b", "same " * 300, " \x0bx" * 250, "é" * 10 + "A", *(" ".join(rng.choice("abcdefghij KLM * 漢字".split()) + str(rng.randrange(60)) for _ in range(rng.choice([3, 190, 199, 200, 201, 230]))) for _ in range(20))]
    docs = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(300)]
    docs += [(i, texts[6], "en") for i in range(100, 180)] + docs[:40]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [None, None, *range(8), *range(4), *range(100, 140)]]
    d = spark.createDataFrame([(i, t, p, True, 1, 2) for i, t, p in docs], "doc_id long, text string, lang string, good boolean, rows int, h int")
    lb = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert rows(A.filter_audit(d, lb)) == brute(docs, labels)
    assert rows(A.filter_audit(d.repartition(7), lb.limit(0))) == brute(docs, [])


def test_empty_tables_and_text_ids(spark):
    d = spark.createDataFrame([("b", "same", "en"), ("a", "same", "en")], "doc_id string, text string, lang string")
    lb = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    assert A.filter_audit(d.limit(0), lb).collect() == []
    got = rows(A.filter_audit(d, lb))
    assert len(got) == 600 and got["en", "EABCD", 1] == (1, 1, 0, 0, 1, 0, 24 * 1 + 24 * 0 + sum(o.index("E") < o.index("A") and o[0] != "E" for o in itertools.permutations("ABCDE")))


def test_long_text(spark):
    text = " ".join(f"w{i % 1000}" for i in range(300_000))
    totals = A.word_totals(spark.createDataFrame([(1, text, None), (1, text, "x"), (None, text, None)], "doc_id long, text string, lang string"))
    assert sorted(((r.doc_id, r.words, r.distinct) for r in totals.collect()), key=str) == [(1, 300_000, 1000), (None, 300_000, 1000)]


@pytest.mark.parametrize("name", ["op13_filter_audit"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = op13_filter_audit(spark, SF)
    want = db.sql(SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
