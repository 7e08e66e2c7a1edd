import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemill.llm import token_counts as T

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "aaaaaaaaaa", "é", " ", "ệ", "가", *"abcdefgh THE the ing 's 't'LL'd漢字ßİΣςⅧ½٣😀\n\t\x0b\x0c\x1c\x1f\x85.,=*-#/_0123'’ﬁ가각﻿ "]


def texts(n=3000):
    rng = random.Random(4)
    return ["", " ", "\n\t", "a", "<|endoftext|>", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(80))) for _ in range(n))]


@pytest.fixture(scope="module")
def model():
    return T.model_json()


@pytest.fixture(scope="module")
def library(model):
    lib = Tokenizer.from_str(model)
    return lambda rows: [len(e.ids) for e in lib.encode_batch(rows, add_special_tokens=False)]


@pytest.mark.parametrize("long", [2, T.LONG])
def test_counts_equal_the_library(model, library, long):
    counter, rows = T.Counter(model, long), texts()
    assert counter.counts([t.encode() for t in rows], 1 << 30) == library(rows)  # all new chunks together
    assert counter.counts([t.encode() for t in rows], 7) == library(rows)  # from memory, in small windows


def test_every_character_counts_as_in_the_library(model, library):
    rows = [f"a{c}b{c} {c}1{c}" for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    assert T.Counter(model).counts([t.encode() for t in rows], 1 << 40) == library(rows)


def test_long_texts_and_long_chunks(model, library):
    rng = random.Random(5)
    rows = ["".join(rng.choice("etaoinshrdlu") for _ in range(50_000)), "a" * 100_001, "ab" * 50_000, "the cat " * 400_000, "漢字" * 20_000]
    counter = T.Counter(model)
    assert [counter.count(t.encode()) for t in rows] == library(rows)
    assert max(map(len, counter.known)) > T.MEMORY_BYTES
    counter.learn([b"one"])
    assert max(map(len, counter.known)) <= T.MEMORY_BYTES


def test_memory_starts_anew(model, library, monkeypatch):
    monkeypatch.setattr(T, "MEMORY", 5)
    counter, rows = T.Counter(model), texts(200)
    assert [counter.count(t.encode(), 20) for t in rows] == library(rows)


def test_merges_against_one_pair_at_a_time():
    """Invented merge tables with pairs of one symbol, against merging the lowest pair from the left again and again."""
    rng = random.Random(6)
    for _ in range(30):
        vocab = {c: i for i, c in enumerate("abcd")}
        merges = []
        while len(merges) < 25:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        rank = {p: i for i, p in enumerate(merges)}
        words = ["".join(rng.choice("aabcd") for _ in range(rng.randrange(1, 60))) for _ in range(50)] + ["a" * 17, "b"]
        want = []
        for word in words:
            parts = list(word)
            while (found := min(((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(99, 0)))[0] < 99:
                parts[found[1]:found[1] + 2] = ["".join(parts[found[1]:found[1] + 2])]
            want.append(len(parts))
        m = T.Merges(vocab, merges)
        for long in (1, 10, 100):
            assert T.merged_sizes(m, *m.symbols(words), long).tolist() == want


def test_a_table_out_of_order_is_refused():
    with pytest.raises(ValueError, match="before one that makes its parts"):
        T.Merges({"a": 0, "b": 1, "c": 2, "bc": 3, "abc": 4}, [("a", "bc"), ("b", "c")])


def test_rows(spark, library):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (3, ""), (4, "word " * 3000), (5, "<|endoftext|> é")]
    docs = spark.createDataFrame([(i, t, "x", 7, 8) for i, t in rows], "doc_id long, text string, n_tokens string, n_bytes int, known int")
    got = [tuple(r) for r in T.token_counts(docs).collect()]
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert T.token_counts(docs, limit=1).filter("over_limit").count() == 4
    assert T.token_counts(docs.limit(0)).collect() == []
    named = T.token_counts(docs.selectExpr("cast(doc_id as string) doc_id", "text"))
    assert dict(named.dtypes)["doc_id"] == "string" and named.count() == 6


def test_query_against_the_library(spark, library):
    from tidemill.llm.queries import op12_token_counts

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op12_token_counts(spark, sf_dir).collect()}
    assert len(got) == len(docs) and np.all([got[d.doc_id].n_tokens == n for d, n in zip(docs, library([d.text or "" for d in docs]))])
