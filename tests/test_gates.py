import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import gates as G
from tidemill.operators import rules as R
from tidemill.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("pattern", "want"), [
    (r"\bblue[\s_-]+cheese\b", ["cheese"]), (r"\b(bolt|gear|anvil)s?\b", ["anvil", "bolt", "gear"]), ("Cold", ["cold"]), ("a", None), ("(ab)?c", None), ("(abc)+x?", ["abc"]),
    ("ab|", None), ("(?!notthis)this", ["this"]), (r"\p{L}bad", None), (r"\Qa.b\E", None), ("(?x) a b c", None), ("[abc]def", ["def"]), ("xx(?:foo|(?:bar|lazy))yy", ["bar", "foo", "lazy"]), ("ſtop", ["stop"]), ("(", None), ("x{0,3}yz", ["yz"]),
])
def test_what_a_pattern_requires(pattern, want):
    assert G.required(pattern) == want


def test_folding_is_that_of_the_expressions(spark):
    pattern = spark._jvm.java.util.regex.Pattern
    odd = [chr(i) for i in range(0x250) if chr(i).isalpha()] + list("ſKÅµμςσΣİıẞﬀѕДжǅǆ")
    for c in odd:
        for other in {c.upper()[:1], c.lower()[:1], G.folded(c), "s", "k", "i", "å"}:
            if pattern.compile(pattern.quote(other), 0x42).matcher(c).matches():
                assert G.folded(c) == G.folded(other), (c, other)


def random_rules(rng, n):
    words = "blue red green cheese bolt ring Straße ſun İzmir naïve".split()
    made = []
    for i in range(n):
        a, b = rng.choice(words), rng.choice(words)
        made.append(R.Rule(rng.choice("st"), f"t{i}", rng.choice([rf"\b{a}\b", rf"\b{a}[\s_-]+{b}\b", f"({a}|{b})s?", f"{a}.*{b}", f"^{a}", "[xyz]", f"{a}(?P<q>b)", "(", "", rf"\p{{Lu}}{a[1:]}", f"(?:{a})?"]), rng.choice(["name", "description", "both"]), rng.random() < 0.9, rng.choice(["", "", b, "(", "old"])))
    return made


def test_gated_equal_plain(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["blue", "RED", "green-cheese", "Cheeses", "strasse STRASSE straße", "sun", "ſun", "izmir İZMİR", "NAÏVE", "old", "x"]) for _ in range(rng.randrange(6))), rng.choice([None, "", "Bolt rings", "blue  cheese"])) for i in range(200)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "id int, a string, b string, section string, key int")
    made = random_rules(rng, 60)
    monkeypatch.setattr(R, "GATED", 10**6)
    plain = sorted(map(tuple, R.text_matches(df, made, "id", "a", "b").collect()))
    monkeypatch.setattr(R, "GATED", 0)
    got = R.text_matches(df, made, "id", "a", "b")
    assert sorted(map(tuple, got.collect())) == plain and len(plain) > 100
    assert R.text_matches(df.limit(0), made, "id", "a", "b").collect() == []


def test_rules_that_only_one_engine_reads(spark):
    df = spark.createDataFrame([(1, "ab", "x")], "id int, a string, b string")
    bad = [R.Rule("s", "t", "a(?P<x>b)"), R.Rule("s", "u", "a(b"), R.Rule("s", "v", "ab", exclude="(")]
    assert R.text_matches(df, bad, "id", "a", "b").collect() == []
    assert [r.target for r in R.text_matches(df, [*bad, R.Rule("s", "w", r"\p{L}b")], "id", "a", "b").collect()] == ["w"]


def test_time_and_plan_hardly_grow_with_the_rules(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(5000)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(20)), "") for i in range(2000)], "id int, a string, b string").cache()
    df.count()
    took, plans = [], []
    for n in (100, 5000):
        found = R.gated_matches(df, [R.Rule("s", w, rf"\b{w}\b") for w in words[:n]], "id", "a", "b")
        plans.append(len(found._jdf.queryExecution().executedPlan().toString()))
        began = time.time()
        assert found.count() > n / 2
        took.append(time.time() - began)
    assert plans[1] < 1.2 * plans[0] and took[1] < 8 * took[0] + 2  # fifty times the rules, and as many matches


def test_one_word_rules_run_no_expression(spark, monkeypatch):
    """Each expression would read the whole text once more."""
    monkeypatch.setattr(R, "GATED", 0)
    monkeypatch.setattr(R, "finds_each", lambda text, pattern: F.raise_error(F.lit("an expression ran")).cast("boolean"))
    df = spark.createDataFrame([(1, "A blue ring, \u00e9bolt; \u201cGEAR\u201d", None), (2, None, "ring")], "id int, a string, b string")
    made = [R.Rule("s", w, rf"\b{w}\b", on) for w, on in (("Blue", "both"), ("ring", "description"), ("bolt", "both"), ("gear", "name"), ("rin", "both"))]
    assert sorted(map(tuple, R.text_matches(df, made, "id", "a", "b").collect())) == [(1, "s", "Blue"), (1, "s", "gear"), (2, "s", "ring")]


def test_whole_words_are_those_of_the_expressions(spark, monkeypatch):
    odd = ["", " ", "_", "-", "7", *"\u00e9\u0301\u201c\u00aa\u00b2\u212a\u017f\u0130\u0131\u0660\u2167\u0903\ua7c0\u08be\u4e2d\u200d\u0378", "\U0001f600", "\U0001d4d0", "\U00010400", "\u00e9\u0301", " \u0301"]
    texts = [x + w + y for w in ("book", "bOO\u212a", "sun", "\u017fun") for x in odd for y in odd]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, a string")
    made = [R.Rule("s", f"{w}{e}", rf"\b{w}\b", exclude=e) for w in ("book", "sun", "Sun") for e in ("", "\u00e9")]
    found = []
    for gate in (10**6, 0):
        monkeypatch.setattr(R, "GATED", gate)
        found.append(sorted(map(tuple, R.step_matches(df, made, "id", "a").collect())))
    assert found[0] == found[1] and 1000 < len(found[0]) < len(texts) * 3
    bounds = G.Words({"book": [3], "ok": [4]}, False)
    assert bounds.told("a Book, b\u00e9ok") == ({3}, {4}) and bounds.told("bo\u00f6ks") == (set(), set()) and bounds.told(None) == (set(), set())


@pytest.mark.parametrize("name", ["rules_many"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows and rows == sorted(want.fetchall())


def test_words_of_ascii_alone_as_in_sql(spark, monkeypatch):
    """A word ends before a letter that isn't ASCII, as in the SQL of the queries; a rule that doesn't ask for it goes on."""
    rows = [(1, "chelle ou\u00e7ouen"), (2, "ou"), (3, "oui"), (4, "\u00e9ou"), (5, "OU\u212a"), (6, "ou_"), (7, "x \u00e7 y"), (8, "ou b")]
    df = spark.createDataFrame(rows, "id int, a string")
    db = duckdb.connect()
    db.sql("CREATE TABLE x (id INT, a VARCHAR)")
    db.executemany("INSERT INTO x VALUES (?, ?)", rows)
    patterns = [r"ou\b", r"\bou\b", r"ou\B", r"\Bou", r"\\b|[\]x]\b"]
    want = [(i, p) for p in patterns for (i,) in db.execute("SELECT id FROM x WHERE regexp_matches(a, ?, 'i')", [p]).fetchall()]
    for gate in (10**6, 0):
        monkeypatch.setattr(R, "GATED", gate)
        got = R.step_matches(df, [R.Rule("s", p, p, ascii=True) for p in patterns], "id", "a").select("id", "target")
        assert sorted(map(tuple, got.collect())) == sorted(want) and (1, r"ou\b") in want
        assert [r.id for r in R.step_matches(df, [R.Rule("s", "t", r"ou\b")], "id", "a").orderBy("id").collect()] == [2, 4, 8]
    assert R.ascii_bounds(r"\Qa\b\E[\b]\b{g}\\b") == r"\Qa\b\E[\b]\b{g}\\b"
