"""Pages over HTTP as a data source: spark.read.format("pages") with a table of contents or a list of URLs.

Options: `toc` (URL of a table of contents in Markdown, whose module links are read) and `base` (what they are relative
to; the table's own folder by default), or `urls` (a JSON list); `partitions` (tasks that fetch, 8), `attempts` (3),
`wait` (seconds before the second attempt, twice as long before each further one, 0.5), `timeout` (30).

A row is url, id (last part of the URL without its ending), html, n_bytes, attempts, error: a page that can't be had
after all attempts has a null html and the last error, and never ends the job.  A page that isn't there (4xx) is not
asked for again.  A task fetches its own pages one after the other and holds one at a time.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, id string, html string, n_bytes long, attempts int, error string"
_MODULE = re.compile(r"\((contents/m[^()\s]*?\.md)\)")


def fetch(url: str, attempts: int = 3, wait: float = 0.5, timeout: float = 30.0) -> tuple[str | None, int, str | None]:
    """(text, attempts made, error) of a page."""
    error = None
    for i in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return r.read().decode("utf-8", "replace"), i, None
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code < 500 and e.code != 429:
                return None, i, error
        except (urllib.error.URLError, OSError, ValueError) as e:
            error = str(getattr(e, "reason", e)) or type(e).__name__
        if i < attempts:
            time.sleep(wait * 2 ** (i - 1))
    return None, attempts, error


def modules(toc: str, base: str) -> list[str]:
    """URLs of the modules of a table of contents, in order, each once."""
    return [urllib.parse.urljoin(base, link) for link in dict.fromkeys(_MODULE.findall(toc))]


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.how = (int(self._option("attempts", "3")), float(self._option("wait", "0.5")), float(self._option("timeout", "30")))

    def _option(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.options.items() if k.lower() == name), default)

    def partitions(self) -> list[InputPartition]:
        if toc := self._option("toc"):
            text, _, error = fetch(toc, *self.how)
            if text is None:
                raise ValueError(f"no table of contents at {toc}: {error}")
            urls = modules(text, self._option("base") or toc)
        else:
            urls = json.loads(self._option("urls", "[]"))
        n = max(1, min(int(self._option("partitions", "8")), len(urls)))
        return [_Urls(urls[i::n]) for i in range(n)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            text, attempts, error = fetch(url, *self.how)
            name = urllib.parse.urlsplit(url).path.rstrip("/").rsplit("/", 1)[-1]
            yield url, name.rsplit(".", 1)[0], text, None if text is None else len(text.encode()), attempts, error


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_pages(spark: SparkSession, **options: str) -> DataFrame:
    """Rows of the source with these options."""
    spark.dataSource.register(Pages)
    return spark.read.format("pages").options(**options).load()


def save_fetched(pages: DataFrame, path: str, source: str = "", license: str = "", attribution: str = "") -> DataFrame:
    """Fetches once, keeps the raw pages under path/raw and a row of metadata for each, had or not, under path/metadata
    (JSON lines); returns the pages as they are stored."""
    spark = pages.sparkSession
    pages.write.mode("overwrite").parquet(f"{path}/raw")
    stored = spark.read.schema(SCHEMA).parquet(f"{path}/raw")
    rows = stored.select("id", "url", F.coalesce("n_bytes", F.lit(0)).alias("size_bytes"), "attempts", "error")
    rows.withColumns({"source": F.lit(source), "license": F.lit(license), "attribution": F.lit(attribution)}).write.mode("overwrite").json(f"{path}/metadata")
    return stored
