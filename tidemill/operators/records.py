"""Records that run over several lines of a log.

A line that opens a record takes the lines after it until they are one JSON value together, or are too many.  Whether
a line opens a record depends on all lines before it, as it may itself be taken.  The state between two lines is the number of
lines still to be taken, so a block's effect is a list of ``MOST`` numbers, and :mod:`scans` tells what reaches each block.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import scans as S

# How a record begins, its lines at most, and what counts as white space around it.
OPENS, MOST = "[summary] ", 51
BLANK = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def _refuse(name: str) -> None:
    raise ValueError(name)


_JSON = json.JSONDecoder(parse_constant=_refuse)


def record(lines: Sequence[str | None]) -> tuple[int, str | None]:
    """How many of ``lines`` the record takes that the first, without its tag, opens, and its JSON; all, and None, if they make up
    no value."""
    lines = [x or "" for x in lines[:MOST]]
    rest = lines[0].strip(BLANK)
    text = "\n".join([rest, *lines[1:]])
    body = text.lstrip(BLANK)
    try:
        _, end = _JSON.raw_decode(body)
    except (ValueError, RecursionError):
        return len(lines), None
    newline = body.find("\n", end)
    tail = body[end:] if newline < 0 else body[end:newline]
    if tail.strip(BLANK):  # more on the value's last line: no longer text is a value either
        return len(lines), None
    return 1 + text.count("\n", 0, len(text) - len(body) + end), body[:end]


def compose(a: list[int], b: list[int]) -> list[int]:
    return [b[s] for s in a]


def effect(steps: Sequence[int]) -> tuple[list[int], list[int]]:
    """A block's effect, and for each line the states, as bits, in which it is not part of a record, given how many lines each takes."""
    n = len(steps)
    open_in = [1 << i if i < MOST else 0 for i in range(n)]
    leaves = [max(s - n, 0) for s in range(MOST)]
    for i, k in enumerate(steps):
        here = open_in[i]
        if i + k < n:
            open_in[i + k] |= here
        elif here:
            for s in range(MOST):
                if here >> s & 1:
                    leaves[s] = i + k - n
    return leaves, open_in


def whole(lines: DataFrame, by: Sequence[str], order: Sequence[str], text: str, size: int = S.SIZE, fan: int = S.FAN) -> DataFrame:
    """``lines`` without those that a record took, and with data: the JSON of the record that a line opens, null if it is none.

    ``order`` tells the lines of a log apart (ties are ordered somehow); a null line is an empty one, and a null key a log of its own."""
    return placed(lines, by, order, text, size, fan).drop(S.AT, S.BLOCK)


def placed(lines: DataFrame, by: Sequence[str], order: Sequence[str], text: str, size: int = S.SIZE, fan: int = S.FAN) -> DataFrame:
    """The same with the places in the log and the blocks that the lines had before (see :mod:`scans`)."""
    clash = {"data", "_at", "_block", "_free", "effect", "state"} & set(lines.columns)
    if clash:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    own = lines.schema.fields
    cut = S.with_next(S.blocked(lines, by, order, size), size, MOST - 1)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def look(table: pa.Table, begins: list[int]) -> pa.Table:
        said, at, blocks = (table.column(c).to_pylist() for c in (text, S.AT, S.BLOCK))
        mine, data, free, effects = [], [], [], []
        for begin, end in zip(begins, begins[1:]):
            n = min(end - begin, (blocks[begin] + 1) * size - at[begin])  # what is behind is the next block's
            steps = [1] * n
            mine.extend(range(begin, begin + n))
            data.extend([None] * n)
            for i in range(n):
                line = said[begin + i]
                if line and line.startswith(OPENS):
                    steps[i], data[i - n] = record([line[len(OPENS):], *said[begin + i + 1:min(begin + i + MOST, end)]])
            leaves, open_in = effect(steps)
            free.extend(open_in)
            effects.append(leaves)
            effects.extend([None] * (n - 1))
        kept = table.take(pa.array(mine, pa.int64()))
        return pa.table({
            **{f.name: kept.column(f.name) for f in own}, S.AT: kept.column(S.AT), S.BLOCK: kept.column(S.BLOCK), "data": pa.array(data, pa.string()),
            "_free": pa.array(free, pa.int64()), "effect": pa.array(effects, pa.list_(pa.int32())),
        })

    seen = written(S.each_block(cut, by, look, f"{kinds}, {S.AT} long, {S.BLOCK} long, data string, _free long, effect array<int>"), "records")
    told = S.reached(seen, by, compose, lambda e, s: e[s], 0, "int", fan)
    return told.filter("shiftrightunsigned(_free, state) & 1 = 1").select(*(f"`{f.name}`" for f in own), "data", S.AT, S.BLOCK)
