"""What the filtering stages keep where ids are null or repeated: each row is judged for itself."""

import pytest

import corpus_pipeline as P
from tidemill.llm import decontaminate, exact_dedup, near_copies, quality

WORDS = "one two three four five six seven eight nine ten eleven twelve"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, node int, _sha int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "en", "s", 1, 2, 3, 4) for r in rows], schema)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def brute_exact(rows):
    largest = {}
    for d, t in rows:
        t = t or ""
        largest[t] = max((x for x in (d, largest.get(t)) if x is not None), default=None)
    return [(d, t) for d, t in rows if largest[t or ""] == d]


def test_exact(spark):
    rows = [(5, "unique text"), (5, "copy"), (9, "copy"), (9, "copy"), (None, "copy"), (None, "alone"), (None, "twice"), (None, "twice"), (3, None), (4, ""), (6, "x " * 60_000), (7, "x " * 60_000)]
    out = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns and left(out) == sorted(brute_exact(rows), key=str)


def test_near(spark):
    other = "entirely other words stand here in this text of ours"
    rows = [(1, WORDS), (5, WORDS), (5, other), (None, WORDS.upper()), (None, "only a null id has this text of eight"), (5, other), (8, None), (9, " "), (None, "")]
    out = near_copies.drop_near_copies(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert left(out) == sorted([(1, WORDS), (5, other), (5, other), (None, "only a null id has this text of eight"), (8, None)], key=str)
    nulls = [(None, WORDS), (None, WORDS + " thirteen"), (None, WORDS + " thirteen")]
    assert len({t for _, t in left(near_copies.drop_near_copies(frame(spark, nulls)))}) in (1, 2)


def test_contaminated(spark):
    items = spark.createDataFrame([(1, "bench item")], "item_id long, text string")
    rows = [(5, "clean words only"), (5, "a bench item"), (None, "bench item"), (None, "clean null id"), (None, None), (7, ""), (7, "clean words only")]
    out = decontaminate.drop_contaminated(frame(spark, rows), items)
    assert out.columns == frame(spark, rows).columns
    assert left(out) == sorted([r for r in rows if "bench item" not in (r[1] or "")], key=str)


def test_low_quality(spark):
    good = "The quick brown fox jumps over the lazy dog. It was a fine day for all of them.\nThey went home, and slept."
    bad = "CLICK $$$ HERE !!! >>> 111 222\nBUY BUY BUY $$$ !!!"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    odd = [(5, bad), (None, bad), (None, good), (3, bad), (3, good), (3, good)]
    out = quality.drop_low_quality(frame(spark, rows + odd), labels)
    assert out.columns == frame(spark, rows).columns
    assert left(out) == sorted([r for r in rows + odd if "CLICK" not in r[1]], key=str)


@pytest.fixture
def folder(spark, tmp_path):
    """Tables with null and repeated ids, repeated rows, empty and very long texts."""
    good = "The quick brown fox number {0} jumps over the lazy dog of house {0}. It was a fine day, {0} of them.\nThey went home, and all {0} slept well."
    docs = [(i, good.format(i)) for i in range(1, 30)]
    docs += [(None, good.format(100)), (None, good.format(101)), (3, good.format(102)), (3, good.format(102)), (None, good.format(5)), (31, good.format(7)), (32, good.format(8).upper())]
    docs += [(40, good.format(40) + " these words are of the benchmark and should not be seen by any model at all"), (None, "these words are of the benchmark and should not be seen by any model at all"), (41, None), (42, ""), (43, " ".join(good.format(i) for i in range(2000, 5000)))]
    frame(spark, docs, "doc_id long, text string, lang string, source string, n_chars long, a int, b int, c int").drop("a", "b", "c").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "these words are of the benchmark and should not be seen by any model at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs


def test_run_on_odd_rows(spark, folder):
    at, docs = folder
    rows = [r for r in brute_exact(docs) if "benchmark" not in (r[1] or "")]
    from tests.llm.test_near_copies import sets, similar

    found, want = [sets(t) for _, t in rows], []
    for i, (d, _) in enumerate(rows):  # the components here are stars around their smallest id
        group = [rows[j][0] for j in range(len(rows)) if similar(found[i], found[j]) or not (found[i] or found[j])]
        if d == min((x for x in group if x is not None), default=None):
            want.append(d)
    out = P.run(spark, at).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted(want, key=str)
    assert all(r.round_trip for r in out)


def test_run_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
