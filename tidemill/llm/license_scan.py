"""License detection by ordered signature rules.

Rules are hand-written regular expressions (license_rules) over a document's lower-cased words joined
by single spaces.  Each is gated by keywords: it only runs on documents that hold one of them, which
word hashes tell without running any expression.  Of overlapping detections, one that lies inside another of higher
rank (priority, then length, then order) is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .license_rules import SIGNATURES

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]  # words without all of which the expression can't match
    pattern: re.Pattern
    priority: int  # of 100; also the detection's score in percent


#: What stands in the signatures for an expression of several words.
SHORT = {
    "LICENSE": "licen[sc]e",
    "UNDER": "(?:(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|open sourced|dual licen[sc]ed) under|subject to|under the terms of|under the conditions of) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?",
    "GRANTED": "(?:licen[sc]ed|open sourced|dual licen[sc]ed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?",
    "MARK": "(?P<mark>)",
    "VER": "(?: (?:version )?(?:v ?)?|v)?",
    "LATER": "(?:only|or (?:at your option )?(?:any )?later(?: version)?)",
}


def build_rules(signatures: str = SIGNATURES) -> list[Rule]:
    """The rules in the order of their lines."""
    rules = []
    for line in signatures.strip().splitlines():
        label, priority, keywords, pattern = line.split(" ", 3)
        for short, meant in SHORT.items():
            pattern = pattern.replace(short, meant)
        rules.append(Rule(label, tuple(keywords.split("|")), re.compile(rf"(?<!\S)(?:{pattern})(?!\S)"), int(priority)))
    return rules


def suppressed(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Of detections (start, end, priority, rule), whether another of higher rank contains it.

    In the order of rank, a detection is suppressed if some earlier one that starts no later ends
    no sooner; a binary indexed tree over the starts holds the largest end."""
    starts = sorted({x[0] for x in found})
    tree = [-1] * (len(starts) + 1)
    gone = [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: (-found[i][2], found[i][0] - found[i][1], found[i][3], found[i][0])):
        start, end = found[i][:2]
        at = place = bisect_right(starts, start)
        most = -1
        while at:
            most = max(most, tree[at])
            at &= at - 1
        gone[i] = most >= end
        while place <= len(starts):
            tree[place] = max(tree[place], end)
            place += place & -place
    return gone


def _scan(words: list[str], rules: list[Rule], by_keyword: dict[str, list[int]], marked: Callable[[int], bool]) -> list[tuple[int, int, int, int]]:
    """Detections in one document: first word, word after the last, priority, rule.  ``marked``: is there a mark right before a word?"""
    joined = " ".join(words)
    offsets = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    found = []
    for k in {k for w in set(words) & by_keyword.keys() for k in by_keyword[w]}:
        for m in rules[k].pattern.finditer(joined):
            if "mark" in rules[k].pattern.groupindex and not marked(bisect_right(offsets, m.start("mark")) - 1):
                continue
            found.append((bisect_right(offsets, m.start()) - 1, bisect_right(offsets, m.end() - 1), rules[k].priority, k))
    return sorted(found)


def license_detections(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, base (first words and labels of
    the base phrases), detections (label, first_word, last_word, score), those suppressed left out.

    A null or empty text has no words and nothing found.  Repeated rows are judged each for itself;
    further columns are ignored."""
    rules = build_rules() if rules is None else rules
    by_keyword: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for word in rule.keywords:
            by_keyword.setdefault(word, []).append(k)
    gates = sorted({*by_keyword, *(p.split()[0] for p in BASE)})
    phrases = [(p.split(), label) for p, label in BASE.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = "".join(gates).encode()
        ends = np.cumsum([len(g) for g in gates])
        wanted = np.sort(C.span_hashes(C.prefix_sums(np.frombuffer(raw, np.uint8)), ends - [len(g) for g in gates], ends))
        for rows, data, bounds in C.chunks(batches):
            data = C.lowered(data)
            starts, ends, firsts = C.word_spans(data, bounds, C.WORD_BYTES)
            hashes = C.span_hashes(C.prefix_sums(data), starts, ends)
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            gated = np.unique(np.searchsorted(firsts, np.flatnonzero(wanted[at] == hashes), "right") - 1)
            base: list[list] = [[] for _ in range(rows.num_rows)]
            kept: list[list] = [[] for _ in range(rows.num_rows)]
            for i in gated.tolist():
                words = C.strings(data, starts[firsts[i]:firsts[i + 1]], ends[firsts[i]:firsts[i + 1]])
                for phrase, label in phrases:
                    n = len(phrase)
                    base[i] += [(j, label) for j, w in enumerate(words) if w == phrase[0] and words[j:j + n] == phrase]
                between = lambda w, i=i: bytes(data[ends[firsts[i] + w - 1]:starts[firsts[i] + w]])
                found = _scan(words, rules, by_keyword, lambda w, between=between: b":" in between(w) or b"=" in between(w))
                kept[i] = [(rules[k].label, a, b - 1, p / 100) for (a, b, p, k), gone in zip(found, suppressed(found)) if not gone]
            yield pa.record_batch({
                "doc_id": rows.column("doc_id"),
                "n_words": pa.array(np.diff(firsts).astype(np.int64)),
                "base": pa.array([[{"word": j, "label": x} for j, x in sorted(b)] for b in base], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                "detections": pa.array([[{"label": x, "first_word": a, "last_word": b, "score": s} for x, a, b, s in k] for k in kept], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))),
            })

    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {id_type}, n_words long, base array<struct<word:bigint,label:string>>, detections array<struct<label:string,first_word:bigint,last_word:bigint,score:double>>")


def license_report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`license_detections`: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_detections.  The score is the strongest detection's; a document
    with base phrases only has 0.5."""
    names = lambda c: F.array_sort(F.array_distinct(c))
    found = license_detections(docs)
    base = F.transform("base", lambda x: x["label"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        F.array_join(names(base), ",").alias("base_labels"),
        F.array_join(names(F.concat(base, F.transform("detections", lambda x: x["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["score"])), F.when(F.size("base") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
