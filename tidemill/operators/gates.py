"""Very many patterns at once: one automaton finds the texts that hold what a pattern requires, and only those patterns run.

From each pattern the driver reads texts of which every match holds one: its longest literal part, or of
alternatives one each.  The literals of all patterns make up one Aho-Corasick automaton, which is built once and
broadcast; a pass over a text gives the patterns that can match, whatever their number.  They are then run by the same regular
expressions as without a gate, so the gate changes nothing but the work.  A pattern that requires nothing, or that the driver
can't read, always runs.

A pattern of one ASCII word between bounds needs no expression at all: a text matches if the word is one of its own, and those are
looked up.  Only words with characters of which engines might think differently go the other way.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from re import _constants as RC
from re import _parser as RP

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals shorter than this are in nearly every text; a pattern with no longer one always runs, as does one with more alternatives.
LEAST, ALTERNATIVES = 2, 64
_folds: dict[int, str] = {}


def folded(text: str) -> str:
    """A text with each character as the regular expressions compare it when case doesn't matter."""
    if text.isascii():
        return text.lower()
    if not _folds:
        for i in range(0x110000):
            c = chr(i)
            up = c.upper() if len(c.upper()) == 1 else c
            low = up.lower()[:1]
            if low != c:
                _folds[i] = low
    return text.translate(_folds)


def required(pattern: str) -> list[str] | None:
    """Folded texts of which each match of the pattern holds one at least; None if that can't be told."""
    try:
        tree = RP.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & (re.VERBOSE | re.LOCALE):
        return None
    found = _of(tree)
    if found is None or min(map(len, found)) < LEAST or len(found) > ALTERNATIVES:
        return None
    return sorted(set(found))


def _of(items) -> list[str] | None:
    """The best alternatives of a sequence: the ones whose shortest text is longest."""
    best: list[str] | None = None
    run = ""

    def better(texts: list[str] | None) -> None:
        nonlocal best
        if texts and all(texts) and (best is None or (min(map(len, texts)), -len(texts)) > (min(map(len, best)), -len(best))):
            best = texts

    for op, arg in items:
        if op is RC.LITERAL:
            run += folded(chr(arg))
            continue
        better([run] if run else None)
        run = ""
        if op is RC.SUBPATTERN:
            better(_of(arg[-1]))
        elif op is RC.BRANCH:
            parts = [_of(b) for b in arg[1]]
            better([t for p in parts for t in p] if all(parts) else None)
        elif op in (RC.MAX_REPEAT, RC.MIN_REPEAT, RC.POSSESSIVE_REPEAT) and arg[0] > 0:
            better(_of(arg[2]))
        elif op is RC.ATOMIC_GROUP:
            better(_of(arg))
    better([run] if run else None)
    return best


class Gate:
    """An automaton of the literals that patterns require; ``always`` are the patterns that it can't tell."""

    def __init__(self, patterns: Sequence[str]) -> None:
        import ahocorasick

        owners: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, p in enumerate(patterns):
            texts = required(p)
            if texts is None:
                self.always.append(i)
            for t in texts or []:
                owners.setdefault(t, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for t, own in owners.items():
            self.automaton.add_word(t, own)
        if owners:
            self.automaton.make_automaton()

    def open_for(self, text: str | None) -> set[int]:
        """The patterns that may match a text."""
        found: set[int] = set(self.always)
        if text and len(self.automaton):
            for _, own in self.automaton.iter(folded(text)):
                found.update(own)
        return found


@functools.cache
def beyond_ascii() -> tuple[str, str]:
    """Characters that make up words, and those of which that can't be told, as ranges of a class.  Told are letters and digits, and
    others, that were so in Unicode 3.2 and still are: versions of engines lie between.  What has the case of an ASCII letter isn't told either,
    nor what is beyond 16 bits, for which classes are slow."""
    ranges: dict[str, list[list[int]]] = {"word": [], "doubt": [[0x10000, 0x10FFFF]]}
    for i in range(0x80, 0x10000):
        c = chr(i)
        then, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
        words = {x[0] == "L" or x == "Nd" for x in (then, now)}
        doubt = len(words) > 1 or "Mn" in (then, now) or now in ("Cn", "Cs") or folded(c).isascii()
        if not doubt and words == {False}:
            continue
        own = ranges["doubt" if doubt else "word"]
        if own and own[-1][1] == i - 1:
            own[-1][1] = i
        else:
            own.append([i, i])
    return tuple("".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in r) for r in ranges.values())


def one_word(pattern: str) -> str | None:
    """The folded word of a pattern that is one ASCII word between bounds; None for any other pattern."""
    found = re.fullmatch(r"\\b([0-9A-Za-z_]+)\\b", pattern)
    return found[1].lower() if found else None


class Words:
    """ASCII words that are looked for as whole ones, whatever their case; ``owners`` are the numbers of each folded word.

    ``wide``: all letters and digits make up words; else no character beyond ASCII is told."""

    def __init__(self, owners: Mapping[str, Sequence[int]], wide: bool) -> None:
        import ahocorasick

        word, doubt = beyond_ascii() if wide else ("", "\\x80-\\U0010ffff")
        self.owners, self.token, self.doubt = dict(owners), re.compile(f"[0-9A-Za-z_{word}{doubt}]+"), re.compile(f"[{doubt}]")
        self.automaton = ahocorasick.Automaton()
        for w, own in self.owners.items():
            self.automaton.add_word(w, own)
        if owners:
            self.automaton.make_automaton()

    def told(self, text: str | None) -> tuple[set[int], set[int]]:
        """Numbers of the words that a text holds, and of those that it may hold."""
        found: set[int] = set()
        may: set[int] = set()
        if text and self.owners:
            for token in set(self.token.findall(text)):
                if token.isascii():
                    found.update(self.owners.get(token.lower(), ()))
                elif self.doubt.search(token):
                    for _, own in self.automaton.iter(folded(token)):
                        may.update(own)
        return found, may - found


def gated(records: DataFrame, patterns: Sequence[str], texts: Mapping[str, Sequence[int]], plain: Sequence[bool], values: pa.StructArray, wide: bool) -> DataFrame:
    """``records`` with two arrays of ``values``, which has one for each pattern: ``open`` of the patterns that may match one of the
    columns ``texts``, ``sure`` of those that match.  Texts for which nothing is open become null.

    ``texts`` has the numbers of the patterns that are for a column.  Only ``plain`` ones, whose :func:`one_word` is all that
    matters, are ever sure.  A null text holds nothing, and only patterns that always run are open for it."""
    rest = [i for i, p in enumerate(plain) if not p]
    owners: dict[str, dict[str, list[int]]] = {c: {} for c in texts}
    for c, own in texts.items():
        for i in own:
            if plain[i]:
                owners[c].setdefault(one_word(patterns[i]), []).append(i)
    sent = records.sparkSession.sparkContext.broadcast((Gate([patterns[i] for i in rest]), {c: Words(o, wide) for c, o in owners.items()}, values))
    own = records.schema.fields
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    kind = "array<struct<" + ", ".join(f"{f.name}: {'boolean' if f.type == pa.bool_() else 'string'}" for f in values.type) + ">>"

    def listed(numbers: list[list[int]], values: pa.StructArray) -> pa.ListArray:
        ends = [0]
        for x in numbers:
            ends.append(ends[-1] + len(x))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array([i for x in numbers for i in x], pa.int32())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, words, values = sent.value
        for batch in batches:
            opened, sure = [], []
            columns = [(words[c], batch.column(batch.schema.get_field_index(c))) for c in texts]
            for i in range(batch.num_rows):
                found: set[int] = set()
                may: set[int] = set()
                for w, column in columns:
                    text = column[i].as_py()
                    held, perhaps = w.told(text)
                    found |= held
                    may |= perhaps
                    may.update(rest[k] for k in gate.open_for(text))
                sure.append(sorted(found))
                opened.append(sorted(may - found))
            none = pa.array([not x for x in opened])
            kept = {f.name: batch.column(f.name) for f in own}
            kept |= {c: pc.if_else(none, pa.scalar(None, kept[c].type), kept[c]) for c in texts}
            yield pa.RecordBatch.from_pydict(kept | {"open": listed(opened, values), "sure": listed(sure, values)})

    return records.mapInArrow(work, f"{kinds}, open {kind}, sure {kind}")


def finds_each(text: Column, pattern: Column) -> Column:
    """Whether a text matches a pattern of the row, whatever its case; a null or empty pattern matches nothing."""
    return F.coalesce(F.rlike(text, F.concat(F.lit("(?iu)"), pattern)) & (pattern != ""), F.lit(False))
