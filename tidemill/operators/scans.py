"""Finite-state scans along an order, where one key may hold most rows.

Rows of a key are cut into blocks of equal length.  What a block does to every state that may reach it is its effect,
and effects compose: those of ``FAN`` neighbouring blocks become one, and so on until a key's effects fit one task.
From there back down each block learns the state that reaches it.  Nothing but effects and states
passes from block to block.  Most keys are one block: those are read many at a time, and no state has to reach them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ordering import numbered

#: Rows of a block, and effects that one task composes.
SIZE, FAN = 4096, 4096
AT, BLOCK = "_at", "_block"


def blocked(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int = SIZE) -> DataFrame:
    """``rows`` with their place in their key, from 0, and the block that it lies in."""
    placed = numbered(rows, by, order, AT).withColumn(AT, F.col(AT) - 1)
    return placed.withColumn(BLOCK, F.floor(F.col(AT) / size).cast("long"))


def with_next(rows: DataFrame, size: int, ahead: int) -> DataFrame:
    """``rows`` of :func:`blocked`, those of the next block's first ``ahead`` places for a second time with the block before.
    A block may look so far ahead, if it is no shorter than that."""
    if ahead > size:
        raise ValueError("a block is shorter than what it looks ahead")
    early = (F.col(AT) % size < ahead) & (F.col(BLOCK) > 0)
    return rows.withColumn(BLOCK, F.explode(F.when(early, F.array(F.col(BLOCK) - 1, F.col(BLOCK))).otherwise(F.array(BLOCK))))


def each_block(cut: DataFrame, by: Sequence[str], look: Callable[[pa.Table, list[int]], pa.Table], kinds: str) -> DataFrame:
    """``look`` on the blocks of :func:`blocked` or :func:`with_next`, many at a time: it gets whole blocks, in order, and where each begins, and
    then the end.  Of a block no more than its own rows are waited for."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*rest, batch])
            at, block = (table.column(c).to_numpy() for c in (AT, BLOCK))
            # a key's block begins at no place that could follow one of the same block of another key
            begins = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (at[1:] != at[:-1] + 1)) + 1).tolist()]
            if len(begins) > 1:
                yield from look(table.slice(0, begins[-1]).combine_chunks(), begins).to_batches()
            rest = table.slice(begins[-1]).combine_chunks().to_batches()
        if rest:
            table = pa.Table.from_batches(rest)
            yield from look(table, [0, table.num_rows]).to_batches()

    return cut.repartition(*by, BLOCK).sortWithinPartitions(*by, BLOCK, AT).mapInArrow(work, kinds)


def reached(seen: DataFrame, by: Sequence[str], compose: Callable[[Any, Any], Any], apply: Callable[[Any, Any], Any], initial: Any, state: str, fan: int = FAN) -> DataFrame:
    """``seen``, whose column effect is null but for one row a block, with the state that reaches each row's block (see :func:`entering`).
    Only keys of several blocks are asked about; the first of a key's blocks is the 0th."""
    effects = seen.filter("effect IS NOT NULL").select(*by, BLOCK, "effect")
    several = effects.filter(F.col(BLOCK) == 1).select(*by)
    keys = [f"_j{i}" for i in range(len(by))]
    same = F.lit(True)
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    asked = written(effects.join(several.toDF(*keys), same, "left_semi"), "several")
    told = joined(seen, entering(asked, by, compose, apply, initial, state, fan), by, [BLOCK])
    return told.withColumn("state", F.when(F.col(BLOCK) == 0, F.lit(initial).cast(state)).otherwise(F.col("state")))


def joined(left: DataFrame, right: DataFrame, by: Sequence[str], more: Sequence[str], how: str = "left") -> DataFrame:
    """Joins on ``by``, where null equals null, and on ``more``; ``right``'s other columns are added."""
    keys = {c: f"_j{i}" for i, c in enumerate((*by, *more))}
    right = right.withColumnsRenamed(keys)
    same = F.lit(True)
    for c, k in keys.items():
        same = same & (F.col(c).eqNullSafe(F.col(k)) if c in by else F.col(c) == F.col(k))
    return left.join(right, same, how).drop(*keys.values())


def entering(effects: DataFrame, by: Sequence[str], compose: Callable[[Any, Any], Any], apply: Callable[[Any, Any], Any], initial: Any, state: str, fan: int = FAN) -> DataFrame:
    """``by``, ``_block`` and state (of the Spark type ``state``): what reaches each block, if ``initial`` reaches the first.

    ``effects``: ``by``, ``_block`` (from 0, without gaps) and effect, one row a block.  ``compose(a, b)`` is the effect of
    ``a`` and then ``b``; ``apply(effect, state)`` the state behind a block."""
    effects = effects.select(*by, BLOCK, "effect")
    keys = [effects.schema[c] for c in by]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + (", " if keys else "")
    value, form = pa_type(state), pa_type(effects.schema["effect"].dataType.simpleString())
    n = len(keys)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, now: Any) -> pa.Table:
        blocks = table.column(BLOCK).to_pylist()
        found, place = [None] * len(blocks), table.column("effect").to_pylist()
        for i in sorted(range(len(blocks)), key=blocks.__getitem__):
            found[i] = now
            now = apply(place[i], now)
        return pa.table({**{f.name: table.column(f.name) for f in keys}, BLOCK: table.column(BLOCK), "state": pa.array(found, value)})

    if (effects.agg(F.max(BLOCK)).first()[0] or 0) < fan:
        return effects.groupBy(*by).applyInArrow(lambda key, table: run(key, table, initial), f"{typed}{BLOCK} long, state {state}")

    coarse = effects.withColumn("_up", F.floor(F.col(BLOCK) / fan).cast("long"))

    def squeeze(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column(BLOCK).to_pylist(), range(table.num_rows)))
        each = table.column("effect").to_pylist()
        whole = each[rows[0][1]]
        for _, i in rows[1:]:
            whole = compose(whole, each[i])
        first = {f.name: table.column(f.name).slice(0, 1) for f in keys}
        return pa.table({**first, BLOCK: pa.array([key[n].as_py()], pa.int64()), "effect": pa.array([whole], form)})

    ups = written(coarse.groupBy(*by, "_up").applyInArrow(squeeze, f"{typed}{BLOCK} long, effect {effects.schema['effect'].dataType.simpleString()}"), "effects")
    above = entering(ups, by, compose, apply, initial, state, fan).withColumnsRenamed({BLOCK: "_up", "state": "_above"})
    told = joined(coarse, above, by, ["_up"])
    return told.groupBy(*by, "_up").applyInArrow(lambda key, table: run(key, table, table.column("_above")[0].as_py()), f"{typed}{BLOCK} long, state {state}")


def pa_type(kind: str) -> pa.DataType:
    """The Arrow type of a Spark type."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)
