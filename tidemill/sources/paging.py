"""Paged services whose pages name the next one: landed pages as tables, and a source that follows the links."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from importlib import import_module
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .scratch import written

API = "/api"


def without_none(url: str) -> str:
    """The address without parameters whose value is the word None."""
    at = urlsplit(url)
    return urlunsplit(at._replace(query=urlencode([(k, v) for k, v in parse_qsl(at.query, keep_blank_values=True) if v != "None"])))


def next_url(current: str, link: object) -> str | None:
    """Where a page's link leads: an address of its own, a path of the same host (under the service's prefix where the page itself
    is), or relative to the page; None without a link."""
    if not isinstance(link, str) or not link:
        return None
    if link.startswith("/"):
        here = urlsplit(current)
        path = link if link.startswith(f"{API}/") or not here.path.startswith(f"{API}/") else API + link
        link = f"{here.scheme}://{here.netloc}{path}"
    return without_none(urljoin(current, link))


def items(page: object) -> tuple[list[dict], bool]:
    """The rows of a page and whether it may name a next one.  A list of objects is a last page; anything else holds no rows."""
    if isinstance(page, list):
        return (page if all(isinstance(x, dict) for x in page) else []), False
    rows = page.get("items") if isinstance(page, dict) else None
    return ([x for x in rows if isinstance(x, dict)], True) if isinstance(rows, list) else ([], False)


def missing(error: Exception) -> bool:
    """Whether a fetcher's error says that there is no such address: a status of 404 on it, or on its response."""
    status = [getattr(x, name, None) for x in (error, getattr(error, "response", None)) for name in ("status_code", "code", "status")]
    return 404 in status


class _Start(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Follower(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options = [f.name for f in schema.fields], options

    def partitions(self) -> list[InputPartition]:
        return [_Start(u) for u in self.options["urls"].split()]

    def read(self, partition: _Start) -> Iterator[tuple]:
        module, _, name = self.options["fetcher"].partition(":")
        fetch, size = getattr(import_module(module), name), self.options.get("perPage", "1000")
        routes = [u if "perPage=" in u or "per_page=" in u else u + ("&" if "?" in u else "?") + f"perPage={size}" for u in partition.url.split("|")]
        url, seen = routes[0], set()
        while url and url not in seen:
            seen.add(url)
            try:
                page = fetch(url)
            except Exception as e:
                if url != routes[0] or len(routes) == 1 or not missing(e):
                    raise
                routes = routes[1:]
                url = routes[0]
                continue
            page = json.loads(page) if isinstance(page, str) else page
            rows, more = items(page)
            for row in rows:
                yield tuple(row.get(f) for f in self.fields)
            url = next_url(url, page.get("next")) if more else None


class Linked(DataSource):
    """A service whose pages link to the next; one task follows the pages of each address.  Options: ``fetcher`` (module:function of an
    address that returns a page's JSON), ``urls`` (between spaces), ``perPage``.  An address may be followed by those of older routes, with
    ``|`` between: the first whose first page isn't missing (404) is read.  Register with ``spark.dataSource.register(Linked)``,
    format ``linked``."""

    @classmethod
    def name(cls) -> str:
        return "linked"

    def schema(self) -> str:
        return "id string, name string, slug string, groupId string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Follower(schema, self.options)


# --- landed pages -------------------------------------------------------------------

def linked_to(url: Column, link: Column) -> Column:
    """:func:`next_url` as an expression, for links without dots in their paths."""
    path = F.when(link.startswith(f"{API}/") | ~url.rlike(rf"^[a-zA-Z]+://[^/]*{API}/"), link).otherwise(F.concat(F.lit(API), link))
    rooted = F.concat(F.regexp_extract(url, "^([a-zA-Z]+://[^/?#]*)", 1), path)
    beside = F.concat(F.regexp_extract(url, "^([^?#]*/)", 1), link)
    to = F.when(link.rlike("^(?i)https?://"), link).when(link.startswith("/"), rooted).when(link.startswith("?"), F.concat(F.regexp_extract(url, "^([^?#]*)", 1), link)).otherwise(beside)
    query = F.regexp_extract(to, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^[^=]*=None$")), "&")
    bare = F.regexp_extract(to, "^([^?#]*)", 1)
    return F.when(F.coalesce(link, F.lit("")) != "", F.concat(bare, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def page_rows(pages: DataFrame, url: str, body: str, schema: str) -> DataFrame:
    """url and the columns of ``schema`` for each row of landed pages: lists, or objects with a list of items; rows that aren't objects are left out."""
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)
    raw = F.coalesce(F.from_json(F.get_json_object(body, "$.items"), "array<string>"), F.from_json(body, "array<string>"))
    each = pages.select(url, F.explode(F.filter(raw, lambda x: F.trim(x).startswith("{"))).alias("x"))
    return each.select(url, F.from_json("x", f"struct<{fields}>").alias("r")).select(url, "r.*")


def reached(pages: DataFrame, url: str, body: str, starts: list[str]) -> DataFrame:
    """The landed pages that a reader comes to from ``starts`` by following links: url.  Pointers are doubled, so the rounds grow as the
    logarithm of the longest chain; each round's tables are written."""
    known = pages.select(url).distinct()
    links = pages.select(F.col(url).alias("a"), linked_to(F.col(url), F.get_json_object(body, "$.next")).alias("b")).filter("b IS NOT NULL AND a <> b").distinct()
    hops = written(links.join(known.select(F.col(url).alias("b")), "b", "left_semi").select("a", "b"), "links")
    found = written(known.filter(F.col(url).isin(starts)).select(F.col(url).alias("a")), "reached")
    n = found.count()
    while True:
        found = written(found.unionByName(found.join(hops, "a").select(F.col("b").alias("a"))).distinct(), "reached")
        more = found.count()
        if more == n:
            return found.select(F.col("a").alias(url))
        n = more
        two = hops.select("a", F.col("b").alias("m")).join(hops.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        hops = written(hops.unionByName(two).distinct(), "links")


def answered(pages: DataFrame, service: str, route: str, status: str, routes: Sequence[str]) -> DataFrame:
    """Of landed pages those of each service's first route, in the order of ``routes``, that answered: it has pages, and none of them is
    missing (404).  A service without such a route has no rows."""
    place = F.array_position(F.array(*map(F.lit, routes)), F.col(route))
    told = pages.filter(place > 0).groupBy(F.col(service).alias("_s"), place.alias("_p")).agg(F.max(F.coalesce(F.col(status) == 404, F.lit(False))).alias("gone"))
    first = told.filter("NOT gone").groupBy("_s").agg(F.min("_p").alias("_p"))
    return pages.withColumn("_place", place).join(first, F.col(service).eqNullSafe(F.col("_s")) & (F.col("_place") == F.col("_p")), "left_semi").drop("_place")
