"""Plans are always made; they are written, and tables replaced, only when asked to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered


@dataclass(frozen=True)
class Mode:
    """Nothing is applied unless ``apply`` is set and ``dry_run`` is not."""

    apply: bool = False
    dry_run: bool = True

    @property
    def executable(self) -> bool:
        return self.apply and not self.dry_run


def report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def replaced(df: DataFrame, path: str, mode: Mode) -> bool:
    """Write ``df`` as the table at ``path`` if the mode says so; whether it was written.  ``df`` may not read from ``path``."""
    if mode.executable:
        df.write.mode("overwrite").parquet(path)
    return mode.executable


def expired(rows: DataFrame, until: Column, now: Column) -> DataFrame:
    """Rows past their time; one that can't be read is past."""
    return rows.filter(F.coalesce(until <= now, F.lit(True)))


def to_rotate(files: DataFrame, by: str, stamp: str, keep: int) -> DataFrame:
    """Files that rotation deletes: all but the newest ``keep`` of each ``by``.  Of files with one stamp the first by their other
    columns are kept."""
    others = [c for c in files.columns if c not in (by, stamp)]
    return numbered(files, [by], [F.desc_nulls_last(stamp), *others], "_rank").filter(F.col("_rank") > keep).drop("_rank")


def success_log(lines: DataFrame, text: str, path: str) -> None:
    """Lines as text files."""
    lines.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)


def checkpointed(done: DataFrame, key: str, path: str) -> None:
    """Adds the keys that have been dealt with to the checkpoint that :func:`tidemill.operators.ingest.unprocessed` reads."""
    done.select(key).distinct().write.mode("append").parquet(path)
