import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tidemill.llm import pieces as P

ALPHA = "abcdefgh thein aost rn THE .,=*-#/_0123é漢😀\n\t"


def texts(n=300):
    rng = random.Random(1)
    return ["", "a", " ", "  a  b ", "\n", "\n\n x", " é😀漢字́ ", "Hello  world\n ab\t", *("".join(rng.choice(ALPHA) for _ in range(rng.randrange(300))) for _ in range(n))]


def unigram():
    """The same pieces as a unigram model; runs of the mark get a usable score."""
    m = sentencepiece_model_pb2.ModelProto()
    with open(P.MODEL_PATH, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1 and p.score < -1e8:
            p.score = -40000.0
    return m.SerializeToString()


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_same_ids_as_the_library(kind):
    proto = None if kind == "bpe" else unigram()
    v = P.vocabulary(proto=proto)
    lib = sentencepiece.SentencePieceProcessor(model_file=P.MODEL_PATH) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
    enc = [x.encode() for x in texts()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in enc])])
    data = np.frombuffer(b"".join(enc), np.uint8)
    for _ in range(2):  # anew, and from memory
        ids, cuts = P.encoded_rows(v, data, bounds)
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == lib.encode(texts())
    raw, ends = P.decoded_rows(v, ids, cuts)
    assert raw == data.tobytes() and (ends == bounds).all()


def test_round_trip_of_rows(spark):
    rows = [(i, t, "x", 5, i % 3) for i, t in enumerate([*texts(40), None, "▁", "a▁ ▁b ▁▁", "x" * 5000, "\x00 \x7f", " " * 70])] + [(0, "twice", "y", 1, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, k int")
    out = P.encode(docs)
    assert out.columns == ["doc_id", "source", "k", "n_tokens", "token_ids", "round_trip"]
    got = out.collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got) and len(got) == len(rows)
    back = sorted((r.doc_id, r.text) for r in P.decode(out).collect())
    assert back == sorted((r[0], r[1] or "") for r in rows)


def test_empty_table(spark):
    assert P.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
