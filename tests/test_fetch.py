"""Files fetched by the executors from a local server: cache, retries, checks."""

from __future__ import annotations

import collections
import hashlib
import http.server
import os
import threading

import pytest

from annolith.sources import readers

BODY = bytes(range(256)) * 5000


@pytest.fixture
def server():
    asked = collections.Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            if self.path == "/missing" or self.path == "/flaky" and asked[self.path] < 3:
                self.send_error(404 if self.path == "/missing" else 503)
                return
            self.send_response(200)
            self.send_header("Content-Length", str(len(BODY) + (self.path == "/short")))
            self.end_headers()
            self.wfile.write(BODY)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_files_are_fetched_once_and_checked(spark, tmp_path, server):
    at, asked = server
    digest = hashlib.sha256(BODY).hexdigest()
    urls = spark.createDataFrame([(f"{at}/a.npy", digest.upper(), len(BODY)), (f"{at}/flaky", None, None), (f"{at}/a.npy", digest.upper(), len(BODY)), (None, None, None)], "url string, sha256 string, length long")
    for _ in range(2):
        got = {r.url: r for r in readers.fetch_all(urls, f"file://{tmp_path}/cache").collect()}
        assert {u: (r.length, r.sha256) for u, r in got.items()} == {f"{at}/a.npy": (len(BODY), digest), f"{at}/flaky": (len(BODY), digest)}
        assert all(open(r.place.removeprefix("file://"), "rb").read() == BODY for r in got.values())
    assert asked == {"/a.npy": 1, "/flaky": 3} and len(os.listdir(tmp_path / "cache")) == 2
    assert readers.fetch(f"{at}/a.npy", f"file://{tmp_path}/cache").endswith("a.npy") and asked["/a.npy"] == 1  # one cache


@pytest.mark.parametrize("path, more", [("missing", {}), ("short", {}), ("a", {"length": 5}), ("a", {"sha256": "00"})])
def test_what_is_wrong_is_an_error_and_leaves_nothing(spark, tmp_path, server, path, more):
    row = {"url": f"{server[0]}/{path}", "length": None, "sha256": None, **more}
    urls = spark.createDataFrame([tuple(row.values())], "url string, length long, sha256 string")
    with pytest.raises(Exception):
        readers.fetch_all(urls, f"file://{tmp_path}/cache", attempts=2).collect()
    assert os.listdir(tmp_path / "cache") == [] and server[1][f"/{path}"] >= 2
