"""REST services as a data source: each page is an input partition, so that pages are fetched side by side.

How many pages there are is told by the `pages` option, else by a total in the first answer;
the last partition goes on, page after page, until the service has no more. Without either,
and behind a cursor, pages are known one after the other only and are one partition. A fetch is
tried again after a pause if the service is busy or out of order; a lost executor's page is
fetched again by the task's next attempt.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources.files import RECORD_KEYS

AGAIN = (429, 500, 502, 503, 504)
BEYOND = (404, 416)
# Fields in which services tell whether there is more, and how much there is.
MORE_KEYS, NEXT_KEY, PAGES_KEY, COUNT_KEY = ("has_more", "has_next"), "next_page", "total_pages", "total_count"
SCHEMA = "page int, record string"


@dataclass
class Page(InputPartition):
    number: int
    last: bool = True


def auth_headers(options: dict[str, str]) -> dict[str, str]:
    """Headers of bearer, basic or key authentication."""
    match options.get("auth", "none"):
        case "bearer":
            return {"Authorization": f"Bearer {options['token']}"}
        case "basic":
            pair = f"{options['user']}:{options['password']}".encode()
            return {"Authorization": "Basic " + base64.b64encode(pair).decode()}
        case "api_key":
            return {options.get("keyname", "X-API-Key"): options["key"]}
    return {}


def records_of(body: Any, path: str | None) -> list[Any]:
    """The records of a response: at a dotted path, or in one of the usual fields, or the response itself."""
    if path:
        for name in path.split("."):
            if isinstance(body, list):
                body = body[int(name)] if name.isdigit() and int(name) < len(body) else []
            else:
                body = body.get(name, []) if isinstance(body, dict) else []
        return body if isinstance(body, list) else [body]
    if isinstance(body, dict):
        return next((body[k] for k in RECORD_KEYS if isinstance(body.get(k), list)), [body])
    return body if isinstance(body, list) else [body]


def has_more(body: Any, records: list[Any]) -> bool:
    """Whether a further page may have records: what the response says, else unless it has none or isn't a list of records."""
    if not records:
        return False
    if isinstance(body, dict):
        for key in (*MORE_KEYS, NEXT_KEY):
            if key in body:
                return body[key] is not None if key == NEXT_KEY else bool(body[key])
    return records != [body]


class RestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Page]:
        o = self.options
        pages = 1
        if o.get("pagination", "none") in ("offset", "page"):
            pages = int(o["pages"]) if "pages" in o else self._told_pages(self._fetch(self._place(0)))
        return [Page(n, n == pages - 1) for n in range(pages)]

    def _told_pages(self, body: Any) -> int:
        """How many pages the first answer tells of; 1 if it doesn't."""
        told = [body.get(k) for k in (PAGES_KEY, COUNT_KEY)] if isinstance(body, dict) else [None, None]
        pages, count = (x if isinstance(x, int) else 0 for x in told)
        return max(1, pages or -(-count // self._size()))

    def _size(self) -> int:
        return int(self.options.get("pagesize", "100"))

    def _place(self, at: int) -> dict[str, Any]:
        """Parameters of the page that begins at a record, or that has a number from 0."""
        o = self.options
        if o["pagination"] == "offset":
            return {o.get("offsetname", "offset"): at, o.get("limitname", "limit"): self._size()}
        return {o.get("pagename", "page"): at + 1, o.get("limitname", "per_page"): self._size()}

    def _pages(self, partition: Page) -> Iterator[tuple[int, list[Any]]]:
        """Records of the partition's page, and if it is the last, of all after it.

        A service may give fewer records than asked for: offsets go on by what came, within a page too.
        """
        size, offset = self._size(), self.options["pagination"] == "offset"
        at = partition.number * (size if offset else 1)
        end = None if partition.last else at + (size if offset else 1)
        before, first = None, True
        while end is None or at < end:
            try:
                body = self._fetch(self._place(at))
            except urllib.error.HTTPError as e:
                if first or e.code not in BEYOND:
                    raise
                return
            records = records_of(body, self.options.get("datapath"))
            if not first and records and (records == before or records == [body]):
                # Beyond the end some services say so in words, or give the last page again.
                if records != [body] and len(records) == size:
                    raise ValueError(f"pages from {at} on are alike; does the service know these parameters? {self._place(at)}")
                return
            yield at // size if offset else at, records[: end - at] if offset and end is not None else records
            if not has_more(body, records):
                return
            at += len(records) if offset else 1
            before, first = records, False

    def _fetch(self, extra: dict[str, Any]) -> Any:
        o = self.options
        url = o["path"] + ("&" if "?" in o["path"] else "?") + urllib.parse.urlencode(extra) if extra else o["path"]
        tries = int(o.get("retries", "3"))
        for attempt in range(tries + 1):
            try:
                request = urllib.request.Request(url, headers={"Accept": "application/json"} | auth_headers(o))
                with urllib.request.urlopen(request, timeout=float(o.get("timeout", "30"))) as answer:
                    time.sleep(float(o.get("pause", "0")))
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or attempt == tries:
                    raise
                time.sleep(float(e.headers.get("Retry-After") or min(30, float(o.get("backoff", "0.5")) * 2**attempt)))

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        o = self.options
        size = self._size()
        told = lambda body, page: ((page, json.dumps(r)) for r in records_of(body, o.get("datapath")))
        match o.get("pagination", "none"):
            case "offset" | "page":
                for page, records in self._pages(partition):
                    yield from ((page, json.dumps(r)) for r in records)
            case "cursor":
                cursor, page = None, 0
                while cursor is not None or not page:
                    body = self._fetch({o.get("limitname", "limit"): size} | ({o.get("cursorname", "cursor"): cursor} if cursor is not None else {}))
                    yield from told(body, page)
                    cursor, page = body.get(o.get("nextfield", "next_cursor")), page + 1
            case _:
                yield from told(self._fetch({}), 0)


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RestReader:
        return RestReader({k.lower(): v for k, v in dict(self.options).items()})


def read_rest(spark: SparkSession, url: str, schema: str | None = None, **options: Any) -> DataFrame:
    """Records of a service as JSON texts, or as columns of a given schema, with the page they came in and where from.

    Options: pagination (none, offset, page, cursor), pageSize, and pages: how many pages to fetch
    side by side, where the service doesn't tell its total_pages or total_count. It is no limit:
    the last of them goes on until the service has no more.
    """
    spark.dataSource.register(RestSource)
    rows = spark.read.format("millrace_rest").options(**{k: str(v) for k, v in options.items()}).load(url)
    if schema is None:
        return rows.withColumn("_api_source", F.lit(url))
    return rows.select(F.from_json("record", schema).alias("r"), F.lit(url).alias("_api_source")).select("r.*", "_api_source")
