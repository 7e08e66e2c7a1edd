"""Token counts of a byte-level BPE tokenizer, by rank-synchronous merging of arrays.

White space ends every pre-token, so texts are cut at ASCII white space and each distinct chunk is counted
once a worker.  The pre-tokens of all new chunks lie end to end in one array of symbols with bounds, and in every
round each sequence's pairs of lowest rank are merged, in all sequences at once; what is left of a sequence when it
has no pair with a rank are its tokens.  A merge never makes a pair of a lower rank than its own
(:class:`Merges` checks that of the table), so a round may merge every occurrence of the lowest pair.

Sequences of over ``LONG`` symbols need more rounds than all others together.  They are merged in the
same order, but with the places of each rank in lists, so that a round costs the places that it changes.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Tokenizer file; a parameter of every function that reads one.
MODEL_NAME = "word_bpe_49k.json"
#: Documents of more tokens are over the limit.
LIMIT = 2048
#: Symbols beyond which a sequence is merged by lists of places.
LONG = 256
#: Distinct chunks that a worker remembers, and the longest, in bytes; with more of them it starts anew.
MEMORY, MEMORY_BYTES = 400_000, 64
#: Bytes of a very long text that are cut into chunks at once.
WINDOW = 1 << 20
_NONE = np.iinfo(np.int32).max
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def model_json(path: str | None = None) -> str:
    """The tokenizer file, which only the driver reads."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL_NAME)
    with open(path, encoding="utf-8") as f:
        return f.read()


class Merges:
    """Ranks and results of the pairs of a merge table, by arrays.

    ``inner`` and ``last`` give the symbol of a byte-level character inside a pre-token and at its end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.size = max(vocab.values(), default=0) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        # The second part of a joined name brings its own suffix.
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(self.size, -1, np.int64)  # the last rank that makes a symbol
        np.maximum.at(born, made, np.arange(len(merges)))
        if len(merges) and not (np.maximum(born[left], born[right]) < np.arange(len(merges))).all():
            raise ValueError("a merge comes before one that makes its parts: pairs of one rank can't be merged at once")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = made.astype(np.int32)
        chars = [c for c in vocab if len(c) == 1]
        top = max(map(ord, chars), default=0) + 1
        self.inner, self.last = np.full(top, -1, np.int32), np.full(top, -1, np.int32)
        for c in chars:
            self.inner[ord(c)] = vocab[c]
            self.last[ord(c)] = vocab.get(c + suffix, -1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; ``_NONE`` where there is none."""
        if not len(self.keys):
            return np.full(len(a), _NONE, np.int32)
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32)

    def symbols(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pre-tokens' first symbols end to end, and the sequences' bounds."""
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))])
        codes = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        sym = self.inner[codes]
        ends = bounds[1:][np.diff(bounds) > 0] - 1
        sym[ends] = self.last[codes[ends]]
        return sym, bounds


def _alternate(after: np.ndarray) -> np.ndarray:
    """Of places in order, those to merge from the left; ``after``: does a place follow right on the one before?"""
    n = np.arange(len(after))
    return (n - np.maximum.accumulate(np.where(after, 0, n))) % 2 == 0


def merged_sizes(m: Merges, sym: np.ndarray, bounds: np.ndarray, long: int = LONG) -> np.ndarray:
    """How many symbols are left of each sequence when all its merges are done."""
    sizes = np.diff(bounds)
    for k in np.flatnonzero(sizes > long):
        sizes[k] = _merged_long(m, sym[bounds[k]:bounds[k + 1]])
    which = np.flatnonzero((np.diff(bounds) <= long) & (sizes > 1))
    if not len(which):
        return sizes
    length = sizes[which]
    total = np.cumsum(length)
    at = np.arange(total[-1]) + np.repeat(bounds[which] - (total - length), length)
    sym = sym[at].copy()
    last = np.zeros(len(sym), bool)
    last[total - 1] = True
    rank = np.full(len(sym), _NONE, np.int32)
    pair = np.flatnonzero(~last)
    rank[pair] = m.rank(sym[pair], sym[pair + 1])
    while True:
        best = np.minimum.reduceat(rank, np.cumsum(length) - length)
        live = best < _NONE
        if not live.all():
            sizes[which[~live]] = length[~live]
            stay = np.repeat(live, length)
            sym, rank, last, which, length, best = sym[stay], rank[stay], last[stay], which[live], length[live], best[live]
            if not len(which):
                return sizes
        lowest = np.repeat(best, length)
        hit = np.flatnonzero(rank == lowest)
        follows = np.zeros(len(hit), bool)
        follows[1:] = np.diff(hit) == 1
        hit = hit[_alternate(follows)]
        sym[hit] = m.made[rank[hit]]
        last[hit] = last[hit + 1]
        gone = np.zeros(len(sym), bool)
        gone[hit + 1] = True
        owner = np.repeat(np.arange(len(which)), length)[hit]
        length = length - np.bincount(owner, minlength=len(which))
        sym, rank, last = sym[~gone], rank[~gone], last[~gone]
        new = hit - np.arange(len(hit))
        rank[new] = _NONE
        before = new[new > 0] - 1
        touched = np.concatenate([new, before])
        touched = touched[~last[touched]]
        rank[touched] = m.rank(sym[touched], sym[touched + 1])


def _merged_long(m: Merges, sym: np.ndarray) -> int:
    """The symbols that are left of one sequence, with the places of every rank in lists."""
    n = len(sym)
    sym = sym.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, _NONE, np.int32)
    rank[:-1] = m.rank(sym[:-1], sym[1:])
    places: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(at: np.ndarray) -> None:
        at = at[rank[at] < _NONE]
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, firsts = np.unique(rank[at], return_index=True)
        for r, group in zip(ranks.tolist(), np.split(at, firsts[1:])):
            if r not in places:
                places[r] = []
                heapq.heappush(queue, r)
            places[r].append(group)

    note(np.arange(n))
    left = n
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[rank[at] == r]  # other places have been merged or have another neighbour by now
        follows = np.zeros(len(at), bool)
        follows[1:] = after[at[:-1]] == at[1:]
        at = at[_alternate(follows)]
        if not len(at):
            continue
        gone = after[at]
        sym[at] = m.made[r]
        rank[at] = rank[gone] = _NONE
        after[at] = after[gone]
        inside = after[at] < n
        before[after[at[inside]]] = at[inside]
        left -= len(at)
        touched = np.unique(np.concatenate([at, before[at]]))
        touched = touched[touched >= 0]
        touched = touched[after[touched] < n]
        rank[touched] = m.rank(sym[touched], sym[after[touched]])
        note(touched)
    return left


class Counter:
    """Counts of texts under a tokenizer file of :func:`model_json`; remembers chunks."""

    def __init__(self, model: str, long: int = LONG) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(model)
        bpe = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if bpe.get(k)]
        strings = [t["content"] for t in spec["added_tokens"]]
        if odd or bpe["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or any(_SPACE.search(s.encode()) for s in strings):
            raise ValueError(f"not a plain BPE with special strings that stand for themselves: {odd}")
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in bpe["merges"]]
        self.merges = Merges(bpe["vocab"], pairs, bpe.get("end_of_word_suffix") or "")
        tokenizer = Tokenizer.from_str(model)
        self.normal, self.pre = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = re.compile("|".join(re.escape(s) for s in sorted(strings, key=len, reverse=True))) if strings else None
        self.known: dict[bytes, int] = {}
        self.long = long

    def _pre_tokens(self, chunk: str) -> tuple[list[str], int]:
        """A chunk's pre-tokens in byte-level characters, and how many special strings it holds."""
        parts, n = [chunk], 0
        if self.special is not None and self.special.search(chunk):
            parts = self.special.split(chunk)
            n = len(parts) - 1
        found: list[str] = []
        for part in parts:
            if part:
                part = self.normal.normalize_str(part) if self.normal else part
                found += [t for t, _ in self.pre.pre_tokenize_str(part)]
        return found, n

    def chunk_counts(self, chunks: list[bytes]) -> list[int]:
        """The chunks' tokens; all their distinct pre-tokens are merged together."""
        place: dict[str, int] = {}
        flat, bounds, counts = [], [0], []
        for chunk in chunks:
            tokens, n = self._pre_tokens(chunk.decode())
            flat += [place.setdefault(t, len(place)) for t in tokens]
            bounds.append(len(flat))
            counts.append(n)
        sizes = merged_sizes(self.merges, *self.merges.symbols(list(place)), self.long)
        sums = np.concatenate([[0], np.cumsum(sizes[np.array(flat, np.int64)])]) if flat else np.zeros(1, np.int64)
        at = np.array(bounds)
        return (sums[at[1:]] - sums[at[:-1]] + np.array(counts, np.int64)).tolist()

    def counts(self, texts: list[bytes], window: int = WINDOW) -> list[int]:
        """The tokens of UTF-8 texts; their new chunks are merged together, if the texts don't exceed a window."""
        if sum(map(len, texts)) > window:
            return [self.count(t, window) for t in texts]
        words = [t.split() for t in texts]
        self.learn([w for row in words for w in row])
        return [sum(map(self.known.__getitem__, row)) for row in words]

    def count(self, text: bytes, window: int = WINDOW) -> int:
        """The tokens of one UTF-8 text, which is cut at white space into windows of about ``window`` bytes."""
        total, at = 0, 0
        while at < len(text):
            to = len(text)
            if to - at > window:
                space = _SPACE.search(text, at + window)
                to = space.end() if space else to
            words = text[at:to].split()
            self.learn(words)
            total += sum(map(self.known.__getitem__, words))
            at = to
        return total

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        elif self.known.pop(b"", None):  # long chunks of the window before
            for word in [w for w in self.known if len(w) > MEMORY_BYTES]:
                del self.known[word]
        fresh = [w for w in set(words) if w not in self.known]
        if fresh:
            self.known.update(zip(fresh, self.chunk_counts(fresh)))
            if max(map(len, fresh)) > MEMORY_BYTES:
                self.known[b""] = 1


_counters: dict[int, Counter] = {}


def _counter(model: str) -> Counter:
    """One counter a worker and tokenizer."""
    key = hash(model)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(model)
    return _counters[key]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Tokens are those of the tokenizer file at ``path`` without any that the library would add; special strings
    inside a text are one token each, in their own spelling only.  A null text counts as empty and has no bytes and
    no tokens.  Repeated or null ids are counted row by row; an empty table gives no rows; further columns
    are ignored.  A text is taken in windows of about a megabyte; only a chunk without white space is taken whole."""
    model = docs.sparkSession.sparkContext.broadcast(model_json(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model.value)
        for rows, data, bounds in C.chunks(batches):
            raw = memoryview(data)
            sizes = np.diff(bounds)
            n = np.array(counter.counts([bytes(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]), np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes.astype(np.int64)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", F.col("text")).mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
