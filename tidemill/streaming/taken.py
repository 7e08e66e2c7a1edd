"""What a stream has taken already, in a log-structured table.

Each batch adds one segment: its keys in hash buckets, and a Bloom filter for every bucket.  ``fan`` segments of a level
become one of the next, so a batch faces a logarithmic number of them; which ones follows from its number alone, and it
never faces its own, so that a batch that is run again takes its rows again.  A batch reads the filters of the buckets
that its keys fall into, and of the segments only the buckets whose filter holds one of its keys: what it reads
follows from its own size, not from how much was taken before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a segment, segments that are merged at once, bits of a filter for each key, and how many of them a key sets.
BUCKETS, FAN, BITS, PROBES = 64, 8, 12, 4


def facing(number: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The segments, as (level, number), that hold all that batches before ``number`` took."""
    found, level = [], 0
    while number:
        found += [(level, k) for k in range(number // fan * fan, number)]
        number, level = number // fan, level + 1
    return found


def merged_by(number: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The segments, as (level, number), that are first faced by batch ``number`` and made of smaller ones, these first."""
    found, level, size = [], 1, fan
    while number and number % size == 0:
        found.append((level, number // size - 1))
        level, size = level + 1, size * fan
    return found


def _places(h: Column, words: Column) -> list[Column]:
    """The numbers of the bits that a key's hash sets in a filter of so many words."""
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [F.pmod(h + step * i, words * 64) for i in range(PROBES)]


class Taken:
    """The table at ``path``; ``read`` notes how many filters and buckets each batch has read."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fan: int = FAN) -> None:
        self.spark, self.path, self.buckets, self.fan = spark, path.rstrip("/"), buckets, fan
        self.read: list[tuple[int, int]] = []

    def _at(self, level: int, number: int) -> str:
        return f"{self.path}/level-{level}/{number}"

    def _remove(self, where: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _exists(self, where: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _hashed(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        h = F.xxhash64(*keys)
        return rows.withColumns({"_h": h, "_b": F.pmod(h, F.lit(self.buckets)).cast("int")})

    def _write(self, rows: DataFrame, where: str) -> None:
        """A segment of distinct keys with _h and _b.  It counts once its filters are there, which are written last."""
        if self._exists(f"{where}/filters"):
            self._remove(f"{where}/filters")
        rows.repartition(F.col("_b")).sortWithinPartitions("_b", "_h").write.mode("overwrite").partitionBy("_b").parquet(f"{where}/rows")
        kept = self.spark.read.schema(rows.schema).parquet(f"{where}/rows").select("_b", "_h")
        sizes = kept.groupBy("_b").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * BITS / 64)).cast("long").alias("words"))
        bits = kept.join(sizes, "_b").select("_b", "words", F.explode(F.array(*_places(F.col("_h"), F.col("words")))).alias("bit"))
        words = bits.groupBy("_b", "words", F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("word"))
        filters = words.groupBy("_b", "words").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("set"))
        full = F.transform(F.sequence(F.lit(0).cast("long"), F.col("words") - 1), lambda i: F.coalesce(F.col("set")[i], F.lit(0).cast("long")))
        filters.select("_b", "words", full.alias("bits")).repartition(F.col("_b")).write.mode("overwrite").partitionBy("_b").parquet(f"{where}/filters")

    def _ready(self, number: int, keys: str) -> None:
        """Merges what batch ``number`` is the first to face, and removes what no batch from it on will."""
        for level, k in merged_by(number, self.fan):
            if not self._exists(f"{self._at(level, k)}/filters/_SUCCESS"):
                parts = [f"{self._at(level - 1, k * self.fan + i)}/rows" for i in range(self.fan)]
                parts = [p for p in parts if self._exists(p)]
                rows = [self.spark.read.schema(keys).parquet(p) for p in parts]
                if rows:
                    merged = rows[0]
                    for more in rows[1:]:
                        merged = merged.unionByName(more)
                    self._write(merged.distinct(), self._at(level, k))
        for level, k in merged_by(number - 1, self.fan) if number else []:
            for i in range(self.fan):
                self._remove(self._at(level - 1, k * self.fan + i))

    def fresh(self, rows: DataFrame, keys: list[str], number: int) -> DataFrame:
        """The rows whose ``keys`` no batch before ``number`` has taken.  Null equals null."""
        hashed = self._hashed(rows, keys)
        schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "_h long", "_b int"])
        self._ready(number, schema)
        segments = [s for s in facing(number, self.fan) if self._exists(f"{self._at(*s)}/filters/_SUCCESS")]
        touched = [r["_b"] for r in hashed.select("_b").distinct().collect()]  # as many as there are buckets, at most
        if not segments or not touched:
            self.read.append((0, 0))
            return rows
        filters = None
        for level, k in segments:
            own = self.spark.read.schema("_b int, words long, bits array<long>").parquet(f"{self._at(level, k)}/filters").filter(F.col("_b").isin(touched))
            own = own.withColumns({"_level": F.lit(level), "_segment": F.lit(k).cast("long")})
            filters = own if filters is None else filters.unionByName(own)
        may = F.lit(True)
        for place in _places(F.col("_h"), F.col("words")):
            may = may & _bit(F.get("bits", F.shiftright(place, 6).cast("int")), place)
        hits = hashed.select("_h", "_b").distinct().join(filters, "_b").filter(may).select("_level", "_segment", "_b").distinct().collect()
        self.read.append((len(segments) * len(touched), len(hits)))
        if not hits:
            return rows
        paths = [f"{self._at(r['_level'], r['_segment'])}/rows/_b={r['_b']}" for r in hits]
        seen = self.spark.read.schema(schema.replace(", _b int", "")).parquet(*paths).select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), F.col("_h").alias("_sh")).distinct()
        same = F.col("_h") == F.col("_sh")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_s{i}"))
        return hashed.join(seen, same, "left_anti").drop("_h", "_b")

    def take(self, fresh: DataFrame, keys: list[str], number: int) -> None:
        """Notes the keys of ``fresh`` as taken by batch ``number``; a batch that is run again replaces what it noted."""
        self._write(self._hashed(fresh.select(*keys).distinct(), keys), self._at(0, number))


def _bit(word: Column, place: Column) -> Column:
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return word.bitwiseAND(mask) != 0


def incremental(events: DataFrame, state_path: str, key: str, version: Column, take: Callable[[DataFrame], None], buckets: int = BUCKETS, fan: int = FAN):
    """A writer that gives ``take`` the rows of each micro-batch whose key hasn't been seen at that version, and remembers
    them in the :class:`Taken` table at ``state_path``.  A batch that is run again finds its own rows and takes them again."""

    def each(batch: DataFrame, number: int) -> None:
        table = Taken(batch.sparkSession, state_path, buckets, fan)
        fresh = table.fresh(batch.withColumn("_version", version.cast("string")), [key, "_version"], number)
        table.take(fresh, [key, "_version"], number)
        take(fresh.drop("_version"))

    return events.writeStream.foreachBatch(each)
