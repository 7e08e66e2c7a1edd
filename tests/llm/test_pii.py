import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.pii import pii_report, pii_spans


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def brute(text):
    spans = [(k, m.start(), m.end()) for k, p, ok in PLAIN for m in re.finditer(p, text or "") if ok(m[0])]
    counts = [sum(s[0] == k for s in spans) for k, *_ in PLAIN]
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())


def report(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, score int")
    rows = {r.doc_id: r for r in pii_report(docs).collect()}
    return [rows[i] for i in range(len(texts))]


def agrees(spark, texts):
    for t, r in zip(texts, report(spark, texts)):
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute(t), t


def test_base_kinds(spark):
    agrees(spark, [
        None, "", "a@b.c", "a@b.c_d@e.f", "a@b..c x@y.z. é😀 q@w.e-.r", "a@b a@b.c@d.e", "1.2.3.4.5.6.7.8", "001.2.3.255 256.1.1.1", "1.2.3.4.é 9.9.9",
        "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "4111111111111111 4111111111111111", "4111 1111 1111 11111111111",
        "+1 (499) 555-6503 +1 2 +123456789012345678", "+1(2)++33 44 55 66 77-", "x+12345678.\n", "a.b.c@d.e.f.\n", "1.2.3.4\n", "..a@b.c", "a@b.c" * 50,
    ])


def test_cards_of_single_digits(spark):
    texts = [" ".join("4111111111111111"), "-".join("4111111111111111"), "row " + "0 " * 16 + "end", " ".join("4111111111111112")]
    agrees(spark, texts)
    assert [r.n_card for r in report(spark, texts)] == [1, 1, 1, 0]


def test_long_texts_need_no_stack(spark):
    long = ["1" * 200_000, "1 " * 100_000, "1." * 100_000, "a." * 100_000 + "@" + "b." * 100_000, "a" * 300_000, "a@b" + ".c" * 150_000, "+1" + "2 " * 100_000]
    for r in report(spark, long):
        assert r.n_card == 0
    assert report(spark, ["a@b" + ".c" * 50_000 + "!"])[0].spans == "email:0:100003"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab1234@.-+ ()_é", max_size=60), min_size=1, max_size=60))
def test_random_texts(spark, texts):
    agrees(spark, texts)


def test_validators_and_context(spark):
    rows = report(spark, ["iban DE89 3704 0044 0532 0130 00 ok", "DE88370400440532013000", "token = \"" + "a1" * 20 + "\"", "a1" * 20, "my ssn 123-45-6789", "000-45-6789"])
    assert [r.spans for r in rows] == ["iban:5:32", "", "secret:9:49", "", "ssn:7:18", ""]
    assert rows[0].score == 1.0 and rows[4].score == 0.5


def test_empty_table(spark):
    assert pii_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_matches_of_one_text(spark):
    """More matches than a block of sums has."""
    text = " ".join(f"a{i}@b.org und 10.0.0.{i % 256}" for i in range(1500))
    got = pii_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = 0
    for i, (e, ip) in enumerate(zip(got.email, got.ip)):
        mail, host = f"a{i}@b.org", f"10.0.0.{i % 256}"
        assert (e.start, e.end) == (at, at + len(mail))
        at += len(mail) + 5
        assert (ip.start, ip.end) == (at, at + len(host))
        at += len(host) + 1
    assert len(got.email) == len(got.ip) == 1500
