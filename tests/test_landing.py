"""Paged sources, loose JSON, entities, a model's ladder and logs on small fixtures."""

import json
from collections import Counter

import pytest

from pyspark.sql import functions as F

import bench
import __spark_entry__ as entry
from tidemill.functions import checks
from tidemill.operators import entities, replies, views
from tidemill.sources import paging

HOST = "https://h.example"
PAGES = {
    f"{HOST}/api/recipes?perPage=2": {"items": [{"id": "1", "name": "a"}, "junk"], "next": "/recipes?page=2&perPage=2&orderBy=None"},
    f"{HOST}/api/recipes?page=2&perPage=2": {"items": [{"id": "2", "name": "b"}], "next": f"{HOST}/api/recipes?page=3&q=None"},
    f"{HOST}/api/recipes?page=3": {"items": [{"id": "3"}], "next": "recipes?page=4"},
    f"{HOST}/api/recipes?page=4": [{"id": "4"}],
    f"{HOST}/api/odd?per_page=1": {"items": "none"},
    f"{HOST}/api/loop?perPage=2": {"items": [{"id": "9"}], "next": "/api/loop?perPage=2"},
}


def fetch(url):
    return json.dumps(PAGES[url])


def test_next_links_are_followed(spark):
    spark.dataSource.register(paging.Linked)
    urls = f"{HOST}/api/recipes {HOST}/api/odd?per_page=1 {HOST}/api/loop"
    df = spark.read.format("linked").option("fetcher", "tests.test_landing:fetch").option("urls", urls).option("perPage", "2").load()
    assert sorted(r.id for r in df.collect()) == ["1", "2", "3", "4", "9"]


LINKS = [
    (f"{HOST}/api/recipes?page=1", "/recipes?page=2&orderBy=None", f"{HOST}/api/recipes?page=2"), (f"{HOST}/api/recipes?page=1", "/api/recipes?page=2", f"{HOST}/api/recipes?page=2"),
    (f"{HOST}/recipes?page=1", "/recipes?page=2", f"{HOST}/recipes?page=2"), (f"{HOST}/api/a/b?x=1", "c?y=2", f"{HOST}/api/a/c?y=2"), (f"{HOST}/api/a?x=1", "?x=2", f"{HOST}/api/a?x=2"),
    (f"{HOST}/api/a", "HTTP://other.example/z?q=None&r=", "HTTP://other.example/z?r="), (f"{HOST}/api/a", None, None), (f"{HOST}/api/a", "", None), (f"{HOST}/api/a", "/b?only=None", f"{HOST}/api/b"),
]


def test_links_as_python_and_as_columns(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(LINKS)], "i int, url string, link string")
    got = {r.i: r.to for r in df.select("i", paging.linked_to(F.col("url"), F.col("link")).alias("to")).collect()}
    for i, (a, b, want) in enumerate(LINKS):
        told = paging.next_url(a, b)
        assert got[i] == want and (told == want or told == want.replace("HTTP", "http"))


def test_landed_pages(spark):
    pages = spark.createDataFrame([(u, json.dumps(b)) for u, b in PAGES.items()], "url string, body string")
    assert sorted(r.id for r in paging.page_rows(pages, "url", "body", "id string").collect()) == ["1", "2", "3", "4", "9"]
    assert paging.reached(pages, "url", "body", [f"{HOST}/api/recipes?page=2&perPage=2"]).count() == 3


def test_entries(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert [e.name for e in one('["Meal Prep", {"name": "meal  prep"}, {"name": " "}, {"x": 1}, "b"]', checks.named_entries)] == ["Meal Prep", "b"]
    assert [(e.name, e.color) for e in one('["a", {"name": "b", "color": "#fff"}]', checks.label_entries)] == [("a", "#959595"), ("b", "#fff")]
    assert one("no json", checks.named_entries) == [] and one(None, checks.tool_entries) == []
    units = one('[{"canonical": "Teaspoon", "abbreviation": "tsp", "aliases": ["t", "T"]}, "x", {"name": "teaspoon"}]', checks.unit_entries)
    assert [(u.name, u.aliases, u.fraction) for u in units] == [("Teaspoon", ["t", "tsp"], True)]
    assert one('["a", "b"]', checks.instructions) == "a b" and one('[{"text": "", "name": "n"}, {"text": "t"}]', checks.instructions) == "n t" and one("plain", checks.instructions) == "plain" and one(None, checks.instructions) == ""


def test_formats(spark):
    cases = {
        checks.username: {"abc": True, "ab": False, "a b c": False, "a" * 65: False}, checks.password: {"Abcdefg1": True, "abcdefg1": False, "Abc1": False, "ABCDEFG1": False},
        checks.host: {"a.b-c.d": True, "-a.b": False, "a..b": False, "10.0.0.1": True}, checks.env_key: {"A_1": True, "a": False, "": False}, checks.container: {"db_1": True, "-x": False},
        checks.service_url: {"http://h:80/x": True, "https://u:p@169.254.169.254/x": False, "ftp://h": False, "x": False},
    }
    for check, texts in cases.items():
        df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
        got = {r.t: r.ok for r in df.select("t", check(F.col("t")).alias("ok")).collect()}
        assert got == texts | {None: False}, check


def test_food_resolution(spark):
    wanted = spark.createDataFrame([("Onion",), (" onion ",), ("Leek",), ("Kale",), ("",), (None,)], "n string")
    known = spark.createDataFrame([("7", "ONION"), ("5", "onion")], "id string, n string")
    got = entities.resolved(wanted, known, "n", "id", spark.createDataFrame([("kale",)], "n string"))
    assert sorted(tuple(r) for r in got.collect()) == [("Kale", None, "review"), ("Leek", None, "create"), ("Onion", "5", "existing")]


ASKED = "tidemill_asked"


def test_a_ladder_asks_each_prompt_once(spark, tmp_path):
    """Batches fail, single prompts answer some records, split prompts others; a second action asks nothing again."""
    log = str(tmp_path / "asked.txt")

    def ask(prompt):
        with open(log, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        head, *lines = prompt.split("\n")
        slugs = [x.split(":")[0][2:] for x in lines]
        if head == "all" and len(slugs) > 1 or head == "all" and slugs[0] in ("c", "d"):
            return "sorry"
        if head != "all" and slugs[0] == "d":
            return None
        return json.dumps([{"slug": s, "tags": [f"{head} {s}"]} if head != "tools" else {"slug": s, "tool": "pan; pot"} for s in slugs])

    df = spark.createDataFrame([(s, f"name {s}", ["x"]) for s in "abcd"], "slug string, name string, parts array<string>")
    found = replies.answered(df, "slug", "name", F.col("parts"), ask, "all", split={"tags": "tags", "tools": "tools"})
    first = sorted((r.slug, r.rung, tuple(r.tags or ()), tuple(r.tools or ())) for r in found.collect())
    assert first == [("a", "single", ("all a",), ()), ("b", "single", ("all b",), ()), ("c", "split", ("tags c",), ("pan", "pot"))]
    assert found.count() == 3 and found.filter("rung = 'split'").count() == 1
    counts = Counter(open(log).read().splitlines())
    assert set(counts.values()) == {1} and sorted(json.loads(x).split("\n")[0] for x in counts) == ["all"] * 5 + ["tags"] * 2 + ["tools"] * 2
    changed = spark.createDataFrame([("a", "tags", 1), ("c", "tools", 2)], "slug string, column string, n int")
    told = replies.counters(df, found.unionByName(found.filter("slug = 'a'").withColumn("slug", F.lit("ghost"))), changed).first().asDict()
    assert told == {"recipes": 4, "by_batch": 0, "by_single": 2, "by_split": 1, "no_classification": 1, "unknown_slugs": 1, "updated": 2, "no_change": 1, "categories_added": 0, "tags_added": 1, "tools_added": 2}


def test_selection(spark):
    df = spark.createDataFrame([(1, ["c"], None, []), (2, ["c"], ["t"], ["x"]), (3, [], ["t"], ["x"])], "id int, c array<string>, t array<string>, l array<string>")
    arrays = {"categories": F.col("c"), "tags": F.col("t"), "tools": F.col("l")}
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(replies.targets(df, "missing-tags", arrays)) == [1] and ids(replies.targets(df, "missing-either", arrays)) == [1, 3] and ids(replies.targets(df, "missing-tags", arrays, replace=True)) == [1, 2, 3]
    assert replies.target_mode() == replies.target_mode(tags=True, tools=True) == "missing-either" and replies.target_mode(tools=True) == "missing-tools"
    assert ids(replies.without_cached(df, spark.createDataFrame([(1,), (2,)], "id int"), "id", arrays)) == [1, 3]


def test_collections_sync_as_asserted(spark):
    schema = "id string, name string, description string, filter string, public boolean, position int"
    existing = spark.createDataFrame([("1", "Dinner", None, "a", None, None), ("2", "Old", "", "b", False, 2), ("3", "Same", "", "c", False, 0), (None, "Broken", "", "d", True, 1)], schema)
    desired = spark.createDataFrame([("dinner", "new", "a", False, 0), ("Same", "", "c", False, 0), ("Fresh", "", "", True, 9), ("broken", "", "d", False, 1)], "name string, description string, filter string, public boolean, position int")
    got = {r.key: r.action for r in entities.collection_plan(existing, desired, replace=True).collect()}
    assert got == {"dinner": "update", "old": "delete", "same": "skip", "fresh": "create", "broken": "missing_id"}
    assert {r.key: r.action for r in entities.collection_plan(existing, desired).collect()}["old"] == "keep"


def test_settings_hide_secrets(spark):
    specs = spark.createDataFrame([("a", "A", "g", True, ""), ("b", "B", "g", False, "d"), ("c", "C", "g", True, "x")], "key string, label string, group string, secret boolean, default string")
    values = spark.createDataFrame([("a", "s3cret", "setting")], "key string, value string, source string")
    assert sorted((r.key, r.value, r.source, r.has_value) for r in views.settings_view(specs, values).collect()) == [("a", "********", "setting", True), ("b", "d", "default", False), ("c", "", "default", False)]


def test_database_tables(spark, tmp_path):
    """A table of an embedded database, written and read by several connections."""
    from tidemill.sources import readers

    url = f"jdbc:derby:{tmp_path}/db"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    try:
        spark.range(100).selectExpr("CAST(id AS INT) AS id", "CONCAT('n', id) AS name").write.jdbc(f"{url};create=true", "foods", "overwrite", options)
    except Exception as e:
        if "ClassNotFound" in str(e) or "EmbeddedDriver" in str(e):
            pytest.skip("no embedded database here")
        raise
    df = readers.jdbc(spark, url, "foods", "ID", 0, 100, 3, **options)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 100 and df.agg(F.sum("ID")).first()[0] == 4950


@pytest.mark.parametrize("name", [n for n in bench.HEADLINE if not n.startswith("op") and n != "pipeline"])
def test_headline_queries_compile(spark, name):
    """No stage's generated code is too large to compile."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
