import pytest

from tidemill.queries import QUERIES, SQL
from tidemill.sources import paging as P


class NotThere(Exception):
    status_code = 404


def fetched(url):
    if "/new/" in url:
        raise NotThere(url)
    if "/broken" in url or "page=2" in url and "gone" in url:
        raise NotThere(url) if "page=2" in url else ValueError(url)
    return {"items": [{"id": url.split("?")[0]}], "next": "/api/gone?page=2&perPage=5" if "gone" in url else None}


def read(spark, urls):
    spark.dataSource.register(P.Linked)
    rows = spark.read.format("linked").schema("id string").option("fetcher", "tests.test_routes:fetched").option("urls", urls).load().collect()
    return sorted(r.id for r in rows)


def test_an_older_route_is_read_where_the_new_one_is_missing(spark):
    assert read(spark, "http://h/api/new/tools|http://h/api/tools http://h/api/old|http://h/api/never") == ["http://h/api/old", "http://h/api/tools"]
    assert read(spark, "http://h/api/new/a|http://h/api/new/b|http://h/api/c") == ["http://h/api/c"]


@pytest.mark.parametrize("urls", ["http://h/api/new/a|http://h/api/new/b", "http://h/api/broken|http://h/api/tools", "http://h/api/gone|http://h/api/tools"])
def test_other_errors_are_errors(spark, urls):
    with pytest.raises(Exception, match="NotThere|ValueError"):
        read(spark, urls)


def test_missing():
    class Response:
        status_code = 404

    class WithResponse(Exception):
        response = Response()

    assert P.missing(WithResponse()) and P.missing(NotThere()) and not P.missing(ValueError("404"))


def test_routes_of_landed_pages(spark):
    pages = spark.createDataFrame([(1, "a", 200), (1, "b", 200), (2, "a", 404), (2, "b", 200), (2, "b", None), (3, "a", 404), (None, "b", 200), (4, "c", 200)], "s int, r string, st int")
    assert sorted(map(tuple, P.answered(pages, "s", "r", "st", ["a", "b"]).collect()), key=str) == sorted([(1, "a", 200), (2, "b", 200), (2, "b", None), (None, "b", 200)], key=str)
    assert P.answered(pages.limit(0), "s", "r", "st", ["a"]).collect() == [] and {"pages_answered"} <= set(QUERIES) & set(SQL)
