"""Paginated HTTP scans.

An endpoint is read page by page until one is empty. Failed requests are retried with growing pauses,
and pages are ``pause`` seconds apart, since the limit on speed is the service's. The pages of one
endpoint depend on each other; several endpoints are the partitions of one scan.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

PAGE, RETRIES, BACKOFF, PAUSE, TIMEOUT = 100, 5, 1.0, 1.0, 30.0
#: Statuses that are tried again.
TRANSIENT = (429, 500, 502, 503, 504)


def get(url: str, headers: dict[str, str] | None = None, retries: int = RETRIES, backoff: float = BACKOFF, timeout: float = TIMEOUT) -> bytes:
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code not in TRANSIENT or attempt == retries:
                raise
        except urllib.error.URLError:
            if attempt == retries:
                raise
        time.sleep(backoff * 2**attempt)
    raise AssertionError


def pages(url: str, params: dict | None = None, headers: dict[str, str] | None = None, fetch: Callable[..., bytes] = get, pause: float = PAUSE, **how) -> Iterator[list]:
    """Lists of documents; ``params`` win over the format, limit and start of this scan."""
    start = 0
    while True:
        query = {"format": "json", "limit": PAGE, "start": start} | (params or {})
        got = json.loads(fetch(f"{url}?{urllib.parse.urlencode(query)}", headers, **how))
        if not got:
            return
        yield got
        if params and "start" in params:
            return  # a fixed start is one page
        start += PAGE
        time.sleep(pause)


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.params = json.loads(self.options.get("params", "{}"))

    def pushFilters(self, filters: list[Filter]):
        """Equalities on ``itemtype``, ``tag`` and ``collection`` become request parameters."""
        names = {"itemtype": "itemType", "tag": "tag", "collection": "collection"}
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in names:
                self.params.setdefault(names[f.attribute[0]], f.value)
            else:
                yield f

    def partitions(self):
        return [_Page(u) for u in (json.loads(self.options["urls"]) if "urls" in self.options else [self.options["path"]])]

    def read(self, partition: _Page):
        headers = json.loads(self.options.get("headers", "{}"))
        n = 0
        for page in pages(partition.url, self.params, headers, pause=float(self.options.get("pause", PAUSE)), retries=int(self.options.get("retries", RETRIES)), backoff=float(self.options.get("backoff", BACKOFF))):
            for doc in page:
                p = self.params
                yield partition.url, n, json.dumps(doc), p.get("itemType"), p.get("tag"), p.get("collection")
                n += 1


class HttpPages(DataSource):
    """``spark.read.format("http_pages").load(url)``; options params and headers (JSON), pause, retries, backoff,
    and urls (a JSON list), for several endpoints in place of one."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, pos long, json string, itemtype string, tag string, collection string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_pages(spark: SparkSession, url: str, params: dict | None = None, headers: dict | None = None, **options) -> DataFrame:
    """``pos``, ``doc`` of an endpoint."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters over
    spark.dataSource.register(HttpPages)
    reader = spark.read.format("http_pages").option("params", json.dumps(params or {})).option("headers", json.dumps(headers or {}))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(url).select("pos", F.parse_json("json").alias("doc"))


def fetch_rdf(url: str, params: dict, export_format: str | None, headers: dict | None = None, fetch: Callable[..., bytes] = get) -> bytes:
    """One page of an endpoint's RDF export."""
    query = {"format": export_format, "limit": PAGE} | params
    return fetch(f"{url}?{urllib.parse.urlencode({k: v for k, v in query.items() if v is not None})}", headers)
