"""Pages over HTTP: fetching in tasks, tables of contents, page bodies."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROP = {"figure", "nav", "footer", "script", "style", "aside"}


def get(url: str, timeout: float = 30.0) -> str | None:
    """Text of a page, None if it can't be read."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.read().decode("utf-8", "replace")
    except (urllib.error.URLError, OSError, ValueError):
        return None


def fetch(urls: DataFrame, url_col: str = "url", reader: Callable[[str], str | None] = get) -> DataFrame:
    """url, text (null on failure), ok, n_bytes; tasks fetch side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            texts = [reader(u) if u else None for u in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(texts, pa.string()), pa.array([t is not None for t in texts]), pa.array([len((t or "").encode()) for t in texts], pa.int64())], ["url", "text", "ok", "n_bytes"])

    return urls.select(F.col(url_col).cast("string")).mapInArrow(run, "url string, text string, ok boolean, n_bytes long")


class _Body(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROP or "note" in (dict(attrs).get("class") or "").split() or (self.skip and tag in ("div", "section")):
            self.skip += 1
        elif tag in ("p", "div", "section", "li", "h1", "h2", "h3", "br"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.skip and (tag in _DROP or tag in ("div", "section")):
            self.skip -= 1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def body_text(html: str) -> str:
    """Text of a page's content without figures, navigation, footers, notes, scripts and styles; at most one blank line
    and one space in a row."""
    found = re.search(r"(?is)<(main|article)\b.*?</\1>", html or "")
    page = _Body()
    page.feed(found.group() if found else html or "")
    page.close()
    return re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", "".join(page.out))).strip()


def bodies(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text of HTML rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([body_text(h) for h in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return pages.select(F.col(id_col).cast("string"), html_col).mapInArrow(run, "id string, text string")


def tree_leaves(state: str) -> list[dict[str, str]]:
    """Leaves (title, slug) of a book tree in a page's preloaded state, in reading order."""
    out: list[dict[str, str]] = []

    def walk(node: dict) -> None:
        children = node.get("contents") or []
        if not children and node.get("slug"):
            out.append({"title": re.sub(r"<[^>]+>", "", node.get("title") or "").strip(), "slug": node["slug"]})
        for child in children:
            walk(child)

    try:
        spec = json.loads(state)
    except ValueError:
        return []
    walk(spec if "contents" in spec else ((spec.get("content") or {}).get("book") or {}).get("tree") or {})
    return out
