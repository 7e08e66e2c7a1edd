import difflib
import random

from pyspark.sql import functions as F

from tidemill.operators import audit, dedup, filters, ingest, rules, runs, sync, taxonomy
from tidemill.operators.rules import Rule


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=str) if not by else [tuple(r) for r in df.orderBy(*by).collect()]


def test_links_dont_multiply(spark):
    rec = spark.createDataFrame([(1,), (2,)], "id int")
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x")], "id int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "id int, v string")
    assert rows(audit.link_counts(rec, "id", {"n_a": (a, "v"), "n_b": (b, "v")})) == [(1, 2, 2), (2, 0, 0)]


def test_scores(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, False)], "id int, a boolean, b boolean")
    s = audit.scored(df, {"a": F.col("a"), "b": F.col("b")})
    assert [(r.id, r.score, r.missing) for r in s.orderBy("id").collect()] == [(1, 1, ["b"]), (2, 0, ["a", "b"])]
    assert rows(audit.distribution(s, 2), "score") == [(0, 1, "bronze"), (1, 1, "bronze"), (2, 0, "bronze")]
    assert [tuple(r)[:4] for r in audit.coverage(s, ["a", "b"]).collect()] == [("b", 0, 2, 2), ("a", 1, 2, 1)]


def test_merge_plan_prefers_usage_then_id(spark):
    foods = spark.createDataFrame([("1", "onion", "g"), ("2", "onion", "g"), ("3", "onion", "h"), ("10", "leek", "g"), ("05", "leek", "g"), ("7", "", "g")], "id string, key string, grp string")
    used = spark.createDataFrame([("1", 9), ("2", 3), ("10", 7), ("05", 7)], "id string, usage long")
    plan = dedup.merge_plan(foods, ["grp", "key"], "id", "key", used)
    assert [(r.source_id, r.target_id) for r in plan.orderBy("source_id").collect()] == [("10", "05"), ("2", "1")]
    links = spark.createDataFrame([(1, "2"), (2, "1"), (3, "10"), (4, None)], "r int, id string")
    assert rows(dedup.rewritten(links, plan, "id").select("r", "id"), "r") == [(1, "1"), (2, "1"), (3, "05"), (4, None)]
    assert sorted(r.id for r in dedup.without(foods, plan, "id").collect()) == ["05", "1", "3", "7"]


def test_keeper(spark):
    df = spark.createDataFrame([(1, "u", "Soup (2)", "s"), (2, "u", "Soup", "soup"), (3, "u", "Soup", "soup-long"), (4, "v", "x", "x"), (5, None, "y", "y"), (6, "", "y", "y")], "id int, url string, name string, slug string")
    got = dedup.keepers(df, ["url"], dedup.name_rank("name", "slug"), "id")
    assert sorted((r.id, r.keeper, r.kept) for r in got.collect()) == [(1, 3, False), (2, 3, False), (3, 3, True)]


def test_alias_wins_over_name(spark):
    units = spark.createDataFrame([("1", "teaspoon"), ("2", "t"), ("3", "t")], "id string, key string")
    aliases = spark.createDataFrame([("t", "teaspoon")], "alias string, canonical string")
    plan = dedup.alias_plan(units, aliases, "id", "key", dedup.merge_plan(units, ["key"], "id", "key"))
    assert rows(plan) == [("2", "1", "alias_map"), ("3", "1", "alias_map")]
    assert rows(dedup.alias_conflicts(spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "alias string, canonical string"))) == [("t", ["a", "b"])]


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(4)
    names = set()
    for _ in range(60):
        base = "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 40)))
        names.add(base)
        for _ in range(2):
            i = rng.randrange(len(base))
            names.add(base[:i] + rng.choice(["", "x", base[i] * 2]) + base[i + rng.randrange(2):])
    names.discard("")
    for least in (0.92, 0.8):
        want = {(a, b) for a in names for b in names if a < b and difflib.SequenceMatcher(a=a, b=b).ratio() >= least}
        df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sorted(names))], "g int, id int, name string")
        got = {(r.a, r.b) for r in dedup.similar_names(df, "g", "id", "name", least).collect()}
        assert got == want


def test_rules(spark):
    rec = spark.createDataFrame([("a", "Spicy Soup", "mild"), ("b", "Stew", "a spicy one"), ("c", None, None)], "slug string, name string, description string")
    rs = [Rule("text_tags", "Spicy", r"\bspicy\b"), Rule("text_tags", "Named", "spicy", match_on="name"), Rule("text_tags", "Off", "stew", enabled=False), Rule("text_tags", "Not stew", "spicy", exclude="one"), Rule("text_tags", "Bad", "(")]
    assert rows(rules.text_matches(rec, rs, "slug", "name", "description")) == [("a", "text_tags", "Named"), ("a", "text_tags", "Not stew"), ("a", "text_tags", "Spicy"), ("b", "text_tags", "Spicy")]
    assert rules.text_matches(rec, [], "slug", "name", "description").count() == 0
    names = spark.createDataFrame([(" Slow  Cooker ",), ("slow cooker",), ("(!)",), ("",)], "name string")
    assert [(r.target, r.pattern) for r in rules.rules_from(names, "name", "tool_tags").collect()] == [("(!)", r"\b\(\!\)\b"), ("Slow Cooker", r"\bSlow[\s_-]+Cooker\b")]


def test_rule_targets(spark):
    wanted = spark.createDataFrame([("Soup",), ("STEW",), ("Ghost",)], "target string")
    known = spark.createDataFrame([("soup ",), ("STEW",)], "name string")
    assert sorted((r.target, r.action) for r in rules.resolved(wanted, known).collect()) == [("Ghost", "drop"), ("STEW", "keep"), ("Soup", "rename")]
    assert {r.action for r in rules.resolved(wanted, known, create=True).filter("target = 'Ghost'").collect()} == {"create"}


def test_filters():
    assert filters.normalized("tags.name  CONTAINS_ANY [\"a\"]") == 'tags.name IN ["a"]'
    ids = {"tags": {"a": "1", "b": "2"}}
    assert filters.with_ids('tags.name IN ["A", "b"] AND tools.name IN ["x"]', ids) == 'tags.id IN ["1", "2"] AND tools.name IN ["x"]'
    assert filters.with_ids('tags.name IN ["a", "nope"]', ids) == 'tags.name IN ["a", "nope"]'
    clauses, errors = filters.parse("tags.name NOT  IN [a, 'b'] and bad.name IN [\"x\"] AND rubbish AND tools.id IN []")
    assert [str(c) for c in clauses] == ['tags.name NOT IN ["a", "b"]'] and len(errors) == 3
    assert filters.parse("") == ([], [])


def test_filter_columns(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, None)], "id int, tags array<string>")
    pick = lambda text: [r.id for r in df.filter(filters.column(filters.parse(text)[0], {"tags": F.col("tags")})).orderBy("id").collect()]
    assert pick('tags.name IN ["a", "z"]') == [1] and pick('tags.name NOT IN ["a"]') == [2, 3] and pick('tags.name CONTAINS ALL ["a", "b"]') == [1]


def test_sync_plan(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("d", None)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 1), ("d", None)], "k string, v int")
    assert rows(sync.plan(old, new, "k", ["v"], replace=True)) == [("a", "delete"), ("b", "update"), ("c", "create"), ("d", "skip")]
    assert rows(sync.difference(old, new, "k", ["v"])) == [("a", 1, "removed"), ("b", 1, "updated"), ("c", 1, "added")]


def test_merge_and_upsert(spark):
    a = spark.createDataFrame([("cup", "", False, ["cups"])], "name string, abbr string, hand boolean, aliases array<string>")
    b = spark.createDataFrame([("cup", "c", True, ["cup.", "cups"]), ("tsp", "t", False, None)], a.schema)
    assert rows(sync.merged(a, b, "name", ["abbr"], ["hand"], ["aliases"])) == [("cup", "c", True, ["cups", "cup."]), ("tsp", "t", False, [])]
    t = spark.createDataFrame([("x", 1, 1)], "k string, seq int, v int")
    c = spark.createDataFrame([("x", 2, 9), ("y", 3, 4)], "k string, seq int, v int")
    assert rows(sync.upserted(t, c, ["k"], "seq")) == [("x", 2, 9), ("y", 3, 4)]
    assert rows(sync.upserted(t, c, ["k"], "seq", overwrite=False)) == [("x", 1, 1), ("y", 3, 4)]


def test_taxonomy(spark):
    names = spark.createDataFrame([("Meal Prep", 3), ("meal-prep", 1), ("a recipe", 9), ("x" * 30, 9), ("", 5)], "name string, usage long")
    assert [(r.key, r.members) for r in taxonomy.similar(names, "name").collect()] == [("meal prep", ["Meal Prep", "meal-prep"])]
    assert [(r.name, r.reasons) for r in taxonomy.problems(names, "name").collect()] == [("meal-prep", ["low_usage"]), ("a recipe", ["noisy_or_over_specific"]), ("x" * 30, ["name_too_long"])]


def test_junk(spark):
    df = spark.createDataFrame([(1, "How to cook rice", "", ""), (2, "Best 5 meals", "", ""), (3, "Soup", "weekly-menu", ""), (4, "Restored bread", "", ""), (5, "Soup", "login", ""), (6, "Soup", "soup", "No instructions found"), (7, "Soup", None, None)], "id int, n string, s string, i string")
    got = [r.j for r in df.orderBy("id").select(ingest.junk_class(F.col("n"), F.col("s"), F.col("i")).alias("j")).collect()]
    assert got == ["how_to", "listicle", "digest", "keyword", "utility", "bad_instructions", None]


def test_candidates(spark):
    rec = spark.createDataFrame([("a", True, "t"), ("b", False, "t"), ("c", None, "t"), ("d", None, "t"), ("e", None, "new")], "slug string, flag boolean, updated string")
    cache = spark.createDataFrame([("c", "t", "parsed"), ("d", "t", "needs_review"), ("e", "old", "parsed")], "slug string, updated_at string, status string")
    go = lambda again: [r.decision for r in ingest.candidates(rec, cache, "slug", F.col("flag"), F.col("updated"), again).orderBy("slug").collect()]
    assert go(False) == ["done", "take", "cached", "cached", "take"] and go(True) == ["done", "take", "cached", "take", "take"]


def test_lines(spark):
    df = spark.createDataFrame([(["For the sauce", "Filling:", " 1  cup ", "", "to serve", "for 4 people"],)], "x array<string>")
    assert df.select(ingest.clean_lines(F.col("x")).alias("y")).first().y == ["1 cup", "for 4 people"]


def test_limits(spark):
    hits = spark.createDataFrame([(1, "u", "2024-01-01 00:00:00"), (2, "u", "2024-01-01 00:00:30"), (3, "u", "2024-01-01 00:01:00"), (4, "v", "2024-01-01 00:00:00")], "id int, k string, s string").withColumn("ts", F.to_timestamp("s"))
    assert [(r.id, r.n) for r in runs.over_limit(hits, "k", "ts", 60, 1).orderBy("id").collect()] == [(1, 1), (2, 2), (3, 2), (4, 1)]
    tries = spark.createDataFrame([(i, "u", f"2024-01-01 00:00:{i:02d}", i != 6) for i in range(9)], "attempt int, k string, s string, failed boolean").withColumn("ts", F.to_timestamp("s"))
    got = [(r.recent, r.blocked) for r in runs.blocked_logins(tries, "k", "ts", F.col("failed")).orderBy("attempt").collect()]
    assert got == [(0, False), (1, False), (2, False), (3, False), (4, False), (5, True), (6, True), (0, False), (1, False)]


def test_islands(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "k int, i int, v string")
    assert [(r.v, r.n) for r in runs.islands(df, "k", "i", "v").orderBy("island").collect()] == [("a", 2), (None, 2), ("b", 1), ("a", 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v string, n int")
    assert dedup.merge_plan(none, ["v"], "k", "v").count() == 0
    assert sync.plan(none, none, "k", ["v"]).count() == 0
    assert dedup.similar_names(none, "v", "k", "v").count() == 0
    assert audit.distribution(audit.scored(none, {"a": F.col("n") > 1}), 1).count() == 2


def test_similar_names_of_a_thousand_characters(spark):
    rng = random.Random(11)
    letters = [chr(0x4E00 + i) for i in range(300)]  # of few letters the matcher takes all for noise
    base = "".join(rng.choice(letters) for _ in range(1000))
    worn = "".join(c for i, c in enumerate(base) if i % 40)
    other = "".join(rng.choice(letters) for _ in range(1000))
    df = spark.createDataFrame([(1, 1, base), (1, 2, worn), (1, 3, other), (2, 4, base[:-1])], "g int, id int, name string")
    assert [(r.a_key, r.b_key) for r in dedup.similar_names(df, "g", "id", "name").collect()] in ([(1, 2)], [(2, 1)])
