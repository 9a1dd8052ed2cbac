"""Pages fetched by URL, as a Spark data source: a partition is a block of URLs, a row a page."""

from __future__ import annotations

import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status int, content string, error string"
#: What a fetch says of itself.
HEADERS = {"User-Agent": "gossamer/1.0", "Accept": "text/html,text/plain;q=0.9"}
_REFRESH = re.compile(r"""<meta[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*?content\s*=\s*["'][^"'=]*=\s*([^"']+)""", re.I)


def fetch(url: str, timeout: float = 10.0, most: int = 16 << 20) -> tuple[str, str | None, int | None, str | None, str | None]:
    """(url, final_url, status, content, error) of a page; redirects are followed, and then one meta refresh.

    An error gives its text and no content. A page of over `most` bytes is an error, not cut;
    so is one that isn't text.
    """
    try:
        at, hops = url, 0
        while True:
            with urllib.request.urlopen(urllib.request.Request(at, headers=HEADERS), timeout=timeout) as r:
                raw, kind, status, at = r.read(most + 1), r.headers.get_content_type(), getattr(r, "status", None), r.geturl()
                charset = r.headers.get_content_charset() or "utf-8"
            if len(raw) > most:
                return url, at, status, None, f"more than {most} bytes"
            if not kind.startswith("text/") and kind != "application/xhtml+xml":
                return url, at, status, None, f"not text: {kind}"
            content = raw.decode(charset, "replace")
            led = _REFRESH.search(content)
            if not led or hops:
                return url, at, status, content, None
            at, hops = urllib.parse.urljoin(at, led[1].strip()), 1
    except urllib.error.HTTPError as e:
        return url, e.url, e.code, None, str(e)
    except (OSError, ValueError, LookupError) as e:
        return url, None, None, None, str(e)


class _Block(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.block, self.timeout = int(options.get("block", 100)), float(options.get("timeout", 10))

    def partitions(self) -> list[_Block]:
        return [_Block(self.urls[i : i + self.block]) for i in range(0, len(self.urls), self.block)] or [_Block([])]

    def read(self, partition: _Block) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch(url, self.timeout)


class PageSource(DataSource):
    """spark.read.format("pages").option("urls", one a line): the named pages. Options block (URLs of a task) and timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetched(urls: DataFrame, timeout: float = 10.0, tasks: int | None = None) -> DataFrame:
    """(url, final_url, status, content, error) of a table of URLs (url), however large; each distinct URL once, null ones left out."""

    def fn(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([fetch(u, timeout) for u in b["url"]], columns=["url", "final_url", "status", "content", "error"]).astype({"status": "Int32"})

    rows = urls.select("url").where(F.col("url").isNotNull()).distinct()
    return (rows.repartition(tasks, "url") if tasks else rows).mapInPandas(fn, SCHEMA)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
