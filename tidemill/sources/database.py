"""Tables of a database as a source, and changes to them in one transaction.

A write is staged first: each task puts its rows into a staging table and tells which attempt it was.  At the commit
the rows of the attempts that count become one change of the target, in one transaction; if a task fails, or the change does,
the target is as it was and the staging table goes.  What was applied and what failed is written in the same
transaction, so a write that was committed can tell its counts later.

Connections come from ``connect``, a ``module:function`` of the options that gives a DB-API connection; without it, from
SQLite's file at ``url``.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from importlib import import_module
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows that are sent to the database at once.
CHUNK = 5000
#: Where the counts of committed writes are kept.
WRITES = "_writes"
MODES = ("update", "upsert", "insert_missing")


def _connect(options: dict[str, str]):
    if "connect" in options:
        module, _, name = options["connect"].partition(":")
        return getattr(import_module(module), name)(options)
    import sqlite3

    return sqlite3.connect(re.sub("^file:(//)?(?=/)", "", options["url"]), timeout=float(options.get("timeout", "60")), isolation_level=None)


def _name(text: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", text):
        raise ValueError(f"not a name that is safe in SQL: {text!r}")
    return f'"{text}"'


def _patient(run, tries: int = 60) -> Any:
    """Waits while others hold the database."""
    for k in range(tries):
        try:
            return run()
        except Exception as e:
            if "locked" not in str(e) and "busy" not in str(e) or k == tries - 1:
                raise
            time.sleep(min(2.0, 0.05 * 2 ** min(k, 5)))


class _Span(InputPartition):
    def __init__(self, least: Any, most: Any, nulls: bool):
        self.least, self.most, self.nulls = least, most, nulls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.columns = dict(options), [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        """As many spans of the integer ``key`` as ``parts``; rows without a key come with the first."""
        parts, key = int(self.options.get("parts", "1")), self.options.get("key")
        if parts < 2 or not key:
            return [_Span(None, None, True)]
        with closing(_connect(self.options)) as db:
            least, most = db.execute(f"SELECT min({_name(key)}), max({_name(key)}) FROM {_name(self.options['table'])}").fetchone()
        if least is None:
            return [_Span(None, None, True)]
        step = (most - least) // parts + 1
        return [_Span(a, a + step, a == least) for a in range(least, most + 1, step)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        said = f"SELECT {', '.join(map(_name, self.columns))} FROM {_name(self.options['table'])}"
        values: tuple = ()
        if partition.least is not None:
            key = _name(self.options["key"])
            said += f" WHERE {key} >= ? AND {key} < ?" + (f" OR {key} IS NULL" if partition.nulls else "")
            values = (partition.least, partition.most)
        with closing(_connect(self.options)) as db:
            found = db.execute(said, values)
            while rows := found.fetchmany(CHUNK):
                yield from rows


@dataclass
class _Staged(WriterCommitMessage):
    attempt: str
    rows: int


class _Writer(DataSourceWriter):
    """Options: ``table``, ``keys`` (comma-separated), ``mode``, ``token`` (names the write), ``partial`` (null keeps what is there)."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.columns = dict(options), [f.name for f in schema.fields]
        self.keys = [k.strip() for k in self.options["keys"].split(",")]
        self.mode = self.options.get("mode", "update")
        self.partial = self.options.get("partial", "false") == "true"
        self.token = self.options.get("token") or uuid.uuid4().hex
        self.stage = _name(f"_stage_{self.token}")
        if self.mode not in MODES or not set(self.keys) <= set(self.columns):
            raise ValueError(f"mode {self.mode!r} of {MODES}, keys {self.keys} of {self.columns}")
        self.values = [c for c in self.columns if c not in self.keys]
        names = ", ".join(f"{_name(c)}" for c in ("_attempt", *self.columns))
        with closing(_connect(self.options)) as db:
            _patient(lambda: db.execute(f"CREATE TABLE IF NOT EXISTS {self.stage} ({names})"))

    def write(self, iterator: Iterator) -> _Staged:
        attempt, n, held = uuid.uuid4().hex, 0, []
        said = f"INSERT INTO {self.stage} VALUES ({', '.join('?' * (len(self.columns) + 1))})"

        def put(rows: list[tuple]) -> None:
            with closing(_connect(self.options)) as db:
                db.execute("BEGIN IMMEDIATE")
                db.executemany(said, rows)
                db.execute("COMMIT")

        for row in iterator:
            held.append((attempt, *row))
            if len(held) == CHUNK:
                _patient(lambda: put(held))
                n, held = n + len(held), []
        if held:
            _patient(lambda: put(held))
        return _Staged(attempt, n + len(held))

    def commit(self, messages: list[_Staged | None]) -> None:
        counted = [m.attempt for m in messages if m is not None]

        def run() -> None:
            with closing(_connect(self.options)) as db:
                db.execute("BEGIN IMMEDIATE")
                try:
                    db.execute(f"CREATE TABLE IF NOT EXISTS {_name(WRITES)} (token PRIMARY KEY, applied, failed)")
                    if db.execute(f"SELECT 1 FROM {_name(WRITES)} WHERE token = ?", (self.token,)).fetchone():
                        raise ValueError(f"a write of the token {self.token!r} has been committed before")
                    db.execute("CREATE TEMP TABLE _counted (attempt PRIMARY KEY)")
                    db.executemany("INSERT INTO _counted VALUES (?)", [(a,) for a in counted])
                    db.execute(f"DELETE FROM {self.stage} WHERE _attempt NOT IN (SELECT attempt FROM _counted)")
                    applied, failed = self._merge(db)
                    db.execute(f"INSERT INTO {_name(WRITES)} VALUES (?, ?, ?)", (self.token, applied, failed))
                    db.execute(f"DROP TABLE {self.stage}")
                    db.execute("COMMIT")
                except BaseException:
                    db.execute("ROLLBACK")
                    raise

        _patient(run)

    def abort(self, messages: list[_Staged | None]) -> None:
        with closing(_connect(self.options)) as db:
            _patient(lambda: db.execute(f"DROP TABLE IF EXISTS {self.stage}"))

    def _merge(self, db) -> tuple[int, int]:
        """How many staged rows were applied and how many failed: rows without a whole key, and rows that the table refuses."""
        keyed = " AND ".join(f"{_name(k)} IS NOT NULL" for k in self.keys)
        total, whole = db.execute(f"SELECT count(*), coalesce(sum({keyed}), 0) FROM {self.stage}").fetchone()
        twice = db.execute(f"SELECT count(*) FROM (SELECT 1 FROM {self.stage} WHERE {keyed} GROUP BY {', '.join(map(_name, self.keys))} HAVING count(*) > 1)").fetchone()[0]
        if twice:
            raise ValueError(f"{twice} keys have several rows: one would win by chance")
        db.execute("SAVEPOINT whole")
        try:
            db.execute(self._change(f"{keyed}"))
            return whole, total - whole
        except Exception as e:
            if type(e).__name__ != "IntegrityError":
                raise
            db.execute("ROLLBACK TO whole")
        # Some row is refused: rows go one by one, and those that are refused are left out.
        failed = total - whole
        for (row,) in db.execute(f"SELECT rowid FROM {self.stage} WHERE {keyed} ORDER BY {', '.join(map(_name, self.keys))}").fetchall():
            db.execute("SAVEPOINT one")
            try:
                db.execute(self._change(f"rowid = {int(row)}"))
            except Exception as e:
                if type(e).__name__ != "IntegrityError":
                    raise
                db.execute("ROLLBACK TO one")
                failed += 1
            db.execute("RELEASE one")
        return total - failed, failed

    def _change(self, where: str) -> str:
        target = _name(self.options["table"])
        new = lambda c, side: f"coalesce({side}.{_name(c)}, {target}.{_name(c)})" if self.partial else f"{side}.{_name(c)}"
        if self.mode == "update":
            sets = ", ".join(f"{_name(c)} = {new(c, 's')}" for c in self.values)
            same = " AND ".join(f"{target}.{_name(k)} = s.{_name(k)}" for k in self.keys)
            return f"UPDATE {target} SET {sets} FROM (SELECT * FROM {self.stage} WHERE {where}) AS s WHERE {same}"
        names = ", ".join(map(_name, self.columns))
        then = "NOTHING" if self.mode == "insert_missing" or not self.values else f"UPDATE SET {', '.join(f'{_name(c)} = ' + new(c, 'excluded') for c in self.values)}"
        return f"INSERT INTO {target} ({names}) SELECT {names} FROM {self.stage} WHERE {where} ON CONFLICT ({', '.join(map(_name, self.keys))}) DO {then}"


class Database(DataSource):
    """A table of a database, read by spans of an integer key and changed in one transaction a write; see the module.
    Register with ``spark.dataSource.register(Database)``, format ``database``."""

    @classmethod
    def name(cls) -> str:
        return "database"

    def schema(self) -> str:
        raise ValueError("give the columns to read, as .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


def read(spark: SparkSession, columns: str, **options: str) -> DataFrame:
    """``columns`` (a schema) of a table; options as told above, with ``parts`` tasks."""
    spark.dataSource.register(Database)
    return spark.read.format("database").schema(columns).options(**options).load()


def changed(plan: DataFrame, order: str | None = None, **options: str) -> tuple[int, int]:
    """Writes ``plan``, and gives how many of its changes were applied and how many failed.

    ``keys`` tell the rows to change, the other columns what they become.  With ``order`` a key may have several rows: they
    are one change, in which each column has its last value that isn't null (``partial``), or the last row's.
    A key of the plan that the table doesn't have changes nothing and counts as applied, as it does for the database; rows
    without a whole key fail, and so do those that break the table's constraints."""
    spark = plan.sparkSession
    spark.dataSource.register(Database)
    keys = [k.strip() for k in options["keys"].split(",")]
    if order is not None:
        values = [c for c in plan.columns if c not in (*keys, order)]
        partial = str(options.get("partial", "false")).lower() == "true"
        last = [F.max_by(F.struct(c), F.when(F.col(c).isNotNull() if partial else F.lit(True), F.struct(order)))[c].alias(c) for c in values]
        whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
        one = plan.filter(whole).groupBy(*keys).agg(*(x for x in last))
        plan = one.unionByName(plan.filter(f"NOT ({whole})").select(*keys, *values))
    token = options.pop("token", None) or uuid.uuid4().hex
    plan.write.format("database").options(token=token, **{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).mode("append").save()
    return outcome(token, **options)


def outcome(token: str, **options: str) -> tuple[int, int]:
    """applied and failed of a committed write."""
    with closing(_connect(options)) as db:
        found = db.execute(f"SELECT applied, failed FROM {_name(WRITES)} WHERE token = ?", (token,)).fetchone()
    if found is None:
        raise LookupError(f"no committed write has the token {token!r}")
    return found


def execute(statement: str, **options: str) -> None:
    """A statement such as the making of a table."""
    with closing(_connect(options)) as db:
        _patient(lambda: db.execute(statement))
