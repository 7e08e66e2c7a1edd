"""SentencePiece encoding and decoding by a Viterbi pass that words share.

Texts are cut into marked words wherever two characters meet that stand side by side in no piece:
before white space that a word follows, and mostly around punctuation and rare letters.  No piece
crosses such a cut, so every distinct word is encoded once.  The distinct words, sorted, are a trie
walked depth-first: a word keeps the forward states of the prefix that it shares with the word
before.

A forward state is the best score of a prefix and its last piece.  In a unigram model the score is
the sum of the pieces' scores.  A BPE model's pieces have ranks, whose sum its merges don't
optimise; there a piece may follow another only if the model's merges leave the two apart, and
fewer pieces are better.  A prefix's forward state is then the last piece of the prefix's own
encoding, so the path is the one that the merges give.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A public SentencePiece model of 32,000 pieces; a parameter of every function that reads one.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_PLAIN_MARK = "\udc81"  # stands for the mark itself in a text; no valid text has it
#: Distinct words that a worker remembers; with more of them it starts anew.
MEMORY = 600_000
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """``pieces``: id by text of those that words are made of; ``scores``: by id; ``bytes_at``: the ids of the 256
    byte pieces; ``shown``: each id's bytes in a decoded text; ``bpe``: whether scores are merge ranks."""

    pieces: dict[str, int]
    scores: list[float]
    bytes_at: list[int]
    shown: list[bytes]
    bpe: bool
    joined: np.ndarray = None  # of the last byte of a character and the first of the next, whether such meet in a piece

    def __post_init__(self) -> None:
        self.joined = np.zeros((256, 256), bool)
        for name in self.pieces:
            chars = [c.encode() for c in name.replace(MARK, " ")]
            for a, b in zip(chars, chars[1:]):
                self.joined[a[-1], b[0]] = True


def vocabulary(path: str = MODEL_PATH, proto: bytes | None = None) -> Vocabulary:
    """The pieces of a model file, which only the driver reads.

    Serves models that add a dummy prefix, have byte pieces and leave texts as they are."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    if proto is None:
        with open(path, "rb") as f:
            proto = f.read()
    model.ParseFromString(proto)
    spec = model.normalizer_spec
    if not (spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.name == "identity" and model.trainer_spec.byte_fallback):
        raise ValueError("not a model with a dummy prefix, byte pieces and no normalisation")
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    pieces, bytes_at, shown = {}, [0] * 256, []
    for i in range(sp.vocab_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_at[int(name[3:5], 16)] = i
            shown.append(bytes([int(name[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            shown.append(b"")
        else:
            pieces[name] = i
            shown.append(name.replace(MARK, " ").encode())
    return Vocabulary(pieces, [sp.get_score(i) for i in range(sp.vocab_size())], bytes_at, shown, model.trainer_spec.model_type == 2)


def merged(text: str, v: Vocabulary) -> list[str]:
    """What BPE makes of a text: the adjacent pair whose join has the best score is joined, the first of equals, until none is a piece."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            found = v.pieces.get(parts[i] + parts[i + 1])
            if found is not None and (best is None or v.scores[found] > best):
                best, at = v.scores[found], i
        if best is None:
            return parts
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Ids of marked words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.root: tuple[dict, int] = ({}, -1)  # what follows by character, and the piece that ends here
        self.names = {}
        for name, i in v.pieces.items():
            if v.bpe and len(merged(name, v)) > 1:
                continue  # no merges lead to it
            node = self.root
            for c in name[:-1]:
                node = node[0].setdefault(c, ({}, -1))
            below = node[0].get(name[-1])
            node[0][name[-1]] = (below[0] if below else {}, i)
            self.names[i] = name
        self.apart: dict[int, bool] = {}
        self.lowest = min((v.scores[i] for i in v.pieces.values()), default=0.0) - UNKNOWN_PENALTY

    def follows(self, a: int, b: int) -> bool:
        """Whether merges leave pieces a and b apart when they stand together."""
        known = self.apart[a << 32 | b] = merged(self.names[a] + self.names[b], self.v) == [self.names[a], self.names[b]]
        return known

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the distinct words, which must be sorted."""
        bpe, scores, root, apart, follows = self.v.bpe, self.v.scores, self.root, self.apart, self.follows
        # By depth: the best score, the last piece (-1: a character without a piece), where it starts, and the pieces begun but not ended.
        best, last, start = [0.0], [-1], [0]
        begun: list[list[tuple[int, dict]]] = [[]]
        found, before = [], ""
        for word in words:
            depth = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                depth += 1
            del best[depth + 1:], last[depth + 1:], start[depth + 1:], begun[depth + 1:]
            for d in range(depth, len(word)):
                c = word[d]
                alive = []
                # A character without a piece of its own may stand alone, at a price; a piece beats it.
                alone = c not in root[0] or root[0][c][1] < 0
                piece, origin = -1, d
                top = (best[d] + (-1.0 if bpe else self.lowest)) if alone else -np.inf
                for s, node in [*begun[d], (d, root[0])]:
                    below = node.get(c)
                    if below is None:
                        continue
                    if below[0]:
                        alive.append((s, below[0]))
                    i = below[1]
                    if i < 0:
                        continue
                    if bpe:
                        score = best[s] - 1.0
                        if score <= top:
                            continue
                        a = last[s]
                        if a >= 0 and s:
                            ok = apart.get(a << 32 | i)
                            if not (follows(a, i) if ok is None else ok):
                                continue
                    else:
                        score = best[s] + scores[i]
                        if score <= top:
                            continue
                    top, piece, origin = score, i, s
                best.append(top)
                last.append(piece)
                start.append(origin)
                begun.append(alive)
            ids: list[int] = []
            d = len(word)
            while d:
                i, s = last[d], start[d]
                if i < 0:
                    ids += [self.v.bytes_at[x] for x in reversed(word[s:d].replace(_PLAIN_MARK, MARK).encode())]
                else:
                    ids.append(i)
                d = s
            ids.reverse()
            found.append(ids)
            before = word
        return found


#: What a worker has encoded so far: places by the words' bytes, all ids end to end, and the places' bounds in them.
_workers: dict[int, tuple[Encoder, dict[bytes, int], array, array]] = {}


def marked_words(v: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes with a space before each row that isn't empty, the words' starts and ends, and the
    rows' bounds in the words.  A word begins at a character that no piece has after the one before."""
    full = np.diff(bounds) > 0
    out = np.insert(data, bounds[:-1][full], 32)
    cuts = bounds + np.concatenate([[0], np.cumsum(full)])
    begins = np.zeros(len(out), bool)
    begins[1:] = ((out[1:] & 0xC0) != 0x80) & ~v.joined[out[:-1], out[1:]]
    begins[cuts[:-1][full]] = True
    starts = np.flatnonzero(begins)
    return out, starts, np.append(starts[1:], len(out))[: len(starts)], np.searchsorted(starts, cuts)


def encoded_rows(v: Vocabulary, data: np.ndarray, bounds: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, and the rows' bounds in them.  Equal words are told by a hash of 64 bits, or ``exact`` by their bytes: the ids
    of a text in which a hash stands for two words don't decode to it, and it is encoded again."""
    key = id(v)
    if key not in _workers:
        _workers.clear()
        _workers[key] = (Encoder(v), {}, array("i"), array("q", [0]))
    encoder, known, flat, offsets = _workers[key]
    out, starts, ends, firsts = marked_words(v, data, bounds)
    raw = out.tobytes()
    if exact:
        number: dict[bytes, int] = {}
        back = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        words = list(number)
    else:
        _, first, back = np.unique(C.span_hashes(C.prefix_sums(out), starts, ends), return_index=True, return_inverse=True)
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if len(known) > MEMORY:
        known.clear()
        del flat[:], offsets[1:]
    fresh = [w for w in words if w not in known]
    texts = [w.decode().replace(MARK, _PLAIN_MARK).replace(" ", MARK) for w in fresh]
    order = sorted(range(len(fresh)), key=texts.__getitem__)
    for k, ids in zip(order, encoder.encode([texts[k] for k in order])):
        known[fresh[k]] = len(offsets) - 1
        flat.extend(ids)
        offsets.append(len(flat))
    place = np.array([known[w] for w in words], np.int64)
    bound = np.frombuffer(offsets, np.int64)
    begin, size = bound[place][back], (bound[place + 1] - bound[place])[back]
    cuts = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - begin, size)
    return np.frombuffer(flat, np.int32)[at] if len(flat) else np.zeros(0, np.int32), cuts[firsts]


def decoded_rows(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The rows' bytes end to end, and their bounds; a row's first byte, the dummy prefix, is left out."""
    sizes = np.array([len(x) for x in v.shown], np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    table = np.frombuffer(b"".join(v.shown), np.uint8)
    size = sizes[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = table[np.arange(ends[-1]) - np.repeat(ends[:-1] - cuts[ids], size)]
    at = ends[bounds]
    heads = at[:-1][np.diff(at) > 0]
    keep = np.ones(len(out), bool)
    keep[heads[out[heads] == 32]] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep].tobytes(), kept[at]


def encode(docs: DataFrame, path: str = MODEL_PATH, v: Vocabulary | None = None) -> DataFrame:
    """The rows of ``docs`` with n_tokens, token_ids and round_trip (do the ids decode to the text's very
    bytes?) in place of text; columns of these names are replaced, others stay.

    A null text is encoded like an empty one, which has no ids.  Characters without a piece, and the mark
    itself, which would decode to a space, become byte pieces."""
    known = docs.sparkSession.sparkContext.broadcast(v or vocabulary(path))
    docs = docs.drop("n_tokens", "token_ids", "round_trip")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    docs = docs.select("text", *(F.col(f"`{f.name}`") for f in rest))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            raw = data.tobytes()
            for exact in (False, True):
                ids, cuts = encoded_rows(known.value, data, bounds, exact)
                back, ends = decoded_rows(known.value, ids, cuts)
                same = back == raw and (ends == bounds).all()
                if same:
                    break
            trips = [True] * rows.num_rows if same else [back[a:b] == raw[x:y] for a, b, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i + 1) for i in range(len(rest))), pa.array(np.diff(cuts).astype(np.int64)), pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(ids)), pa.array(trips, pa.bool_())],
                [*(f.name for f in rest), "n_tokens", "token_ids", "round_trip"],
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return docs.mapInArrow(work, f"{kinds}n_tokens long, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, path: str = MODEL_PATH, v: Vocabulary | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and token_ids.  Null or empty ids give an empty text; bytes that are
    not UTF-8, which no encoded text has, are replaced."""
    known = tokens.sparkSession.sparkContext.broadcast(v or vocabulary(path))
    tokens = tokens.select("doc_id", F.coalesce("token_ids", F.array().cast("array<int>")).alias("token_ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            raw, ends = decoded_rows(known.value, lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())], ["doc_id", "text"])

    return tokens.mapInArrow(work, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
