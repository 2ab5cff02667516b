"""The HTTP source against a server on this machine."""

import http.server
import json
import threading
from collections import Counter

import pytest

from graphloom.sources import http as pages

TOC = "# Book\n* [One](contents/m1.md)\n* [Two](contents/m2.md)\n* [One again](contents/m1.md)\n* [Gone](contents/m404.md)\n* [Slow](contents/m503.md)\n[x](other/m9.md)"


@pytest.fixture
def server():
    seen = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            name = self.path.rsplit("/", 1)[-1]
            code, body = 200, f"<p>é {name}</p>"
            if name == "toc.md":
                body = TOC
            elif name == "m404.md":
                code = 404
            elif name == "m503.md" and seen[self.path] < 3 or name == "m500.md":
                code = 503
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/book", seen
    own.shutdown()


def test_table_of_contents_and_pages(spark, server, tmp_path):
    base, seen = server
    df = pages.read_pages(spark, toc=f"{base}/toc.md", partitions="3", wait="0.01")
    assert df.rdd.getNumPartitions() == 3
    stored = pages.save_fetched(df, f"file://{tmp_path}/book", license="CC BY 4.0")
    got = {r.id: r for r in stored.collect()}
    assert set(got) == {"m1", "m2", "m404", "m503"}
    assert got["m1"].html == "<p>é m1.md</p>" and got["m1"].n_bytes == len("<p>é m1.md</p>".encode()) and got["m1"].error is None
    assert (got["m404"].html, got["m404"].attempts, got["m404"].error) == (None, 1, "HTTP 404")
    assert (got["m503"].html, got["m503"].attempts) == ("<p>é m503.md</p>", 3)
    assert seen["/book/contents/m1.md"] == 1  # fetched once, read from the raw table after that
    rows = {r.id: r for r in spark.read.json(f"file://{tmp_path}/book/metadata").collect()}
    assert rows["m404"].size_bytes == 0 and rows["m404"].error == "HTTP 404" and {r.license for r in rows.values()} == {"CC BY 4.0"}


def test_lists_of_urls_and_failures(spark, server):
    base, seen = server
    urls = [f"{base}/a.html", f"{base}/m500.md", "http://127.0.0.1:9/none", "no url"]
    got = {r.url: r for r in pages.read_pages(spark, urls=json.dumps(urls), attempts="2", wait="0.01", timeout="2").collect()}
    assert got[urls[0]].html and [got[u].html for u in urls[1:]] == [None] * 3
    assert got[urls[1]].error == "HTTP 503" and got[urls[1]].attempts == 2 and all(got[u].error for u in urls[2:])
    assert pages.read_pages(spark, urls="[]").count() == 0
    with pytest.raises(Exception, match="no table of contents"):
        pages.read_pages(spark, toc=f"{base}/m404.md").collect()
