"""Tables, nested JSON catalogs, paged services, databases, text blocks and logs as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.ordering import running

#: A record as services list it; times are free text, yields numbers.
RECORD = (
    "id string, slug string, name string, description string, recipeYield string, recipeYieldQuantity double, recipeServings double, "
    "prepTime string, totalTime string, performTime string, cookTime string, orgURL string, originalURL string, source string, "
    "recipeCategory array<struct<id:string,name:string,slug:string,groupId:string>>, tags array<struct<id:string,name:string,slug:string,groupId:string>>, "
    "tools array<struct<id:string,name:string,slug:string,groupId:string>>, nutrition map<string,string>, hasParsedIngredients string, "
    "updatedAt string, dateUpdated string, createdAt string, recipeInstructions array<struct<text:string,name:string>>, "
    "recipeIngredient array<struct<food:struct<id:string,name:string,groupId:string>,unit:struct<id:string,name:string>,quantity:double,note:string,originalText:string,rawText:string,display:string>>"
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def catalog(spark: SparkSession, path: str, schema: str = RECORD, whole: bool = True) -> DataFrame:
    """Records of landed JSON: lists, or pages with their rows under ``items``, one a file (or one a line, or a record a line, unless ``whole``);
    rows that don't fit become null rows and are dropped."""
    raw = spark.read.text(path, wholetext=whole)
    lists = raw.select(F.coalesce(
        F.from_json("value", f"struct<items:array<struct<{_colons(schema)}>>>")["items"],
        F.from_json("value", f"array<struct<{_colons(schema)}>>"),
    ).alias("rows"))
    return lists.select(F.explode("rows").alias("r")).filter("r IS NOT NULL").select("r.*")


def _colons(schema: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def jdbc(spark: SparkSession, url: str, name: str, key: str, least: int, most: int, parts: int, **options: str) -> DataFrame:
    """A database table, read by ``parts`` connections that share out the range of an integer key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=least, upperBound=most, numPartitions=parts, properties=options)


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options = [f.name for f in schema.fields], options

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(int(self.options.get("pages", "1")))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        module, _, name = self.options["fetcher"].partition(":")
        page = getattr(import_module(module), name)(partition.number, int(self.options.get("perPage", "1000")))
        page = json.loads(page) if isinstance(page, str) else page
        for row in page.get("items", []) if isinstance(page, dict) else page:
            if isinstance(row, dict):
                yield tuple(row.get(f) for f in self.fields)


class Paged(DataSource):
    """A paged service: one task a page.  Options: ``fetcher`` (module:function of page number and size that returns
    a page's JSON), ``pages``, ``perPage``.  Register with ``spark.dataSource.register(Paged)``, format ``paged``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, name string, slug string, groupId string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(schema, self.options)


def env_lines(lines: DataFrame, text: str = "value", keep: list[str] | None = None) -> DataFrame:
    """The columns to ``keep``, key and value of KEY=VALUE lines: with or without export, quotes around values dropped, comments and others left out."""
    line = F.regexp_replace(F.trim(text), r"^export\s+", "")
    key, value = F.trim(F.substring_index(line, "=", 1)), F.trim(F.substr(line, F.instr(line, "=") + 1))
    bare = F.regexp_replace(value, r"^([\"'])(.*)\1$", "$2")
    return lines.filter(F.contains(F.col(text), F.lit("=")) & ~F.trim(text).startswith("#") & (key != "")).select(*(keep or []), key.alias("key"), bare.alias("value"))


def service_settings(lines: DataFrame, keep: list[str], text: str, order: str, names: dict[str, str], override: str | None = None) -> DataFrame:
    """The columns to ``keep``, key and value of the settings in ``names`` (as files call them, to ours), from lines of env files and of compose
    files: with or without ``- `` and export, KEY=VALUE or KEY: VALUE less its comment, quotes dropped, the last of a key.  A value for
    ``override`` takes the place of all others of its ``keep``."""
    line = F.regexp_replace(F.regexp_replace(F.trim(text), "^- +", ""), "^(?i)export ", "")
    equals = F.contains(line, F.lit("="))
    key = F.when(equals, F.substring_index(line, "=", 1)).otherwise(F.substring_index(line, ":", 1))
    value = F.when(equals, F.substr(line, F.instr(line, "=") + 1)).otherwise(F.regexp_replace(F.substr(line, F.instr(line, ":") + 1), " #.*$", ""))
    bare = lambda c: F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    rows = lines.filter((equals | F.contains(line, F.lit(":"))) & ~F.trim(text).startswith("#")).select(*keep, F.col(order).alias("_o"), F.upper(bare(key)).alias("_k"), bare(value).alias("value"))
    known = F.coalesce(*(F.when(F.col("_k") == k, F.lit(v)) for k, v in names.items()))
    rows = rows.withColumn("key", known).filter("key IS NOT NULL AND value <> ''").groupBy(*keep, "key").agg(F.max_by("value", "_o").alias("value"))
    if override is None:
        return rows
    whole = rows.filter(F.col("key") == override).select(*keep).distinct()
    return rows.filter(F.col("key") == override).unionByName(rows.filter(F.col("key") != override).join(whole, keep, "left_anti"))


def blocks(lines: DataFrame, order: str, text: str = "value", by: list[str] | None = None, marker: str = "__CFG_FILE__:") -> DataFrame:
    """The blocks that marker lines begin: path and body, the first block of a path only."""
    line = F.trim(text)
    marked = lines.withColumn("_m", line.startswith(marker)).withColumn("_all", F.lit(0))
    marked = running(marked, by or ["_all"], [order], F.col("_m").cast("int"), "block")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_m"), F.struct(F.col(order).alias("o"), line.alias("t"))))), lambda x: x["t"]), "\n")
    found = marked.filter("block > 0").groupBy(*(by or []), "block").agg(F.max(F.when(F.col("_m"), F.trim(F.substr(line, F.lit(len(marker) + 1))))).alias("path"), body.alias("body"))
    return found.filter("path <> ''").groupBy(*(by or []), "path").agg(F.min_by("body", "block").alias("body"))


def tail(lines: DataFrame, order: str, n: int, without: Column | None = None) -> DataFrame:
    """The last ``n`` lines, in order, less those that ``without`` tells are noise."""
    kept = lines if without is None else lines.filter(~F.coalesce(without, F.lit(False)))
    return kept.orderBy(F.desc(order)).limit(n).orderBy(order)


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of rows; an empty table if there is none or it isn't JSON."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def report_summary(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """available and the columns of a report that was written as JSON before: one row, with nulls if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.range(1).select(F.lit(False).alias("available"), *(F.lit(None).cast("string").alias(c) for c in columns))
    return spark.read.json(path).limit(1).select(F.lit(True).alias("available"), *columns)


def managed_files(spark: SparkSession, root: str, files: list[tuple[str, str, str]]) -> DataFrame:
    """name, path, exists and expected type of the files (name, path, type) that a root should hold."""
    rows = []
    for name, path, kind in files:  # a few names
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        rows.append((name, path, at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at), kind))
    return spark.createDataFrame(rows, "name string, path string, exists boolean, expected_type string")
