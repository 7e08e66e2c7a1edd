import pandas as pd
from pyspark.sql import functions as F

from tidemill.functions import numbers, text


def values(spark, f, inputs):
    """f of each input, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_titles(spark):
    names = ["o'brien potato salad", "bbq's best ribs", "how to make bread", "how-to-cook_rice recipe", "recipe for soup of the day", "(spicy) soup, with a dip", "VALENTINE'S cake", "  ", "don't stop", "soup for", None]
    want = ["O'Brien Potato Salad", "BBQ's Best Ribs", "Bread", "Rice", "Soup of the Day", "(Spicy) Soup, with a Dip", "Valentine's Cake", "", "Don't Stop", "Soup For", ""]
    assert values(spark, text.clean_title, names) == want


def test_needs_title(spark):
    f = lambda every: lambda c: text.needs_title(c, F.lit("slug"), every)
    assert values(spark, f(False), ["lemon tea", "Lemon tea", "Lemon Tea", " "]) == [True, False, False, False]
    assert values(spark, f(True), ["lemon tea", "Lemon tea", "Lemon Tea", " "]) == [True, True, False, False]


def test_urls(spark):
    urls = ["HTTPS://www.Example.com//a//b/?utm_source=x&b=2&a=1#top", "https://example.com", "//wow.com/x", "http://h.org/?q=a+b%7E*&q=z&empty=&UTM_Medium=y", "", None, "https://h.org/a/;p?x=%zz", "https://www.wow.com/"]
    want = ["https://example.com/a/b?a=1&b=2", "https://example.com/", "https://ow.com/x", "http://h.org/?q=z", "", "", "https://h.org/a?x=%25zz", "https://ow.com/"]
    got = values(spark, text.canonical_url, urls)
    assert got == want


def test_keys_and_slugs(spark):
    assert values(spark, text.name_key, [" Red\t ONION ", None]) == ["red onion", ""]
    assert values(spark, text.folded_key, [" Straße  Ａ ", "ﬁne", None]) == ["strasse a", "fine", ""]
    assert values(spark, text.plain_slug, ["--A b!c--", "", None]) == ["a-b-c", "", ""]
    assert values(spark, text.latin_slug, ["Crème Brûlée's", "日本"]) == ["creme-brulees", ""]
    assert values(spark, text.numeric_suffix, ["a (2)", "a (2) b", "a(10)", None]) == [True, False, True, False]
    assert values(spark, lambda c: text.short(c, 6), ["abcdef", "abcdefg"]) == ["abcdef", "abc..."]
    assert values(spark, text.split_names, [" a; b ,,c ", "", None]) == [["a", "b", "c"], [], []]


def test_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string")
    assert [round(r.y, 3) for r in df.select(text.matching_ratio("a", "b").alias("y")).collect()] == [0.75, 1.0, 0.0]


def test_quantities(spark):
    assert values(spark, numbers.quantity, ["1 1/2 cups", "½", "1½", "3/4", "2.5 kg", "none", None, "1/0"]) == [1.5, 0.5, 1.5, 0.75, 2.5, 0.0, 0.0, None]


def test_yields(spark):
    texts = ["6", "4-6", "2.5", "Serves 4", "makes about 6", "12 cookies", "2 dozen", "a dozen", "1 1/2 dozen", "½ loaf", "some", "", None, "6–8 servings"]
    assert values(spark, numbers.yield_number, texts) == [6.0, 4.0, 2.5, 4.0, 6.0, 12.0, 24.0, 12.0, 24.0, 0.5, None, None, None, 6.0]


def test_yield_actions(spark):
    rows = [(0, None, 4.0, 0.0), (1, "", 0.0, 1.0), (2, "6 servings", 0.0, 0.0), (3, "4 servings", 0.0, 4.0), (4, "4 servings", 4.0, 4.0), (5, "some", 0.0, 0.0), (6, "", None, None)]
    df = spark.createDataFrame(rows, "i int, t string, q double, s double")
    got = [r.a and tuple(r.a) for r in df.select("i", numbers.yield_action(F.col("t"), F.col("q"), F.col("s")).alias("a")).orderBy("i").collect()]
    assert got == [("set_text", "4 servings", 4.0), ("set_text", "1 serving", 1.0), ("set_servings", "6 servings", 6.0), ("sync_qty", "4 servings", 4.0), None, None, None]


def test_times(spark):
    assert values(spark, lambda c: numbers.elapsed(c.cast("double")), ["12.34", "59.97", "65", "119.6"]) == ["12.3s", "1m 0s", "1m 5s", "2m 0s"]
    assert values(spark, lambda c: numbers.clock(c.cast("double")), ["3661.5", "-4"]) == ["01:01:01", "00:00:00"]
    got = values(spark, lambda c: numbers.moment(c).cast("string"), ["2024-01-02T03:04", "2024-01-02T03:04:05Z", "2024-01-02T05:04:05+02:00", "soon", None])
    assert got == ["2024-01-02 03:04:00", "2024-01-02 03:04:05", "2024-01-02 03:04:05", None, None]


def test_lists_and_words(spark):
    assert values(spark, numbers.value_list, ['"a", "b c"', "a, 'b'", "", None]) == [["a", "b c"], ["a", "b"], [], []]
    assert values(spark, numbers.truth, [" ON ", "0", "x", None]) == [True, False, None, None]


def test_json_repair(spark):
    replies = ['```json\n[{"a": 1}]\n```', "talk [{a: 1,}] talk", '[{"a": 1}, {"b": [2}', '[{"a": 1}, {"b"', '{"items": [1]}', "no", '[{“a”: “it\'s”, "u": "http://x, y: z"}]', None]
    want = ['[{"a": 1}]', '[{"a": 1}]', '[{"a": 1}]', '[{"a": 1}]', "[1]", None, '[{"a": "it\'s", "u": "http://x, y: z"}]', None]
    got = values(spark, numbers.repaired_json, replies)
    assert [None if pd.isna(x) else x for x in got] == want
