"""The live source against a server of this test's own."""

import http.server
import json
import threading

import pytest

from loomaudit.sources import web


class Handler(http.server.BaseHTTPRequestHandler):
    seen: dict[str, int] = {}

    def answer(self):
        path = self.path
        Handler.seen[self.command + path] = times = Handler.seen.get(self.command + path, 0) + 1
        status, kind, body, more = 200, "text/html", b"<p>fine, and long enough</p>", {}
        if path == "/refuses" and self.command == "HEAD":
            status = 405
        elif path == "/busy" and times == 1 and self.command == "HEAD":
            status, more = 429, {"Retry-After": "0"}
        elif path == "/gone":
            status = 404
        elif path == "/soft":
            body = b"<h1>Page not found</h1>"
        elif path == "/moved":
            status, more = 302, {"Location": "/there"}
        elif path == "/loop":
            status, more = 302, {"Location": "/loop"}
        elif path == "/favicon.ico":
            status, kind = (405 if self.command == "HEAD" else 200), "image/x-icon"
        elif path == "/robots.txt":
            kind, body = "text/plain", b"User-agent: *"
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        for k, v in more.items():
            self.send_header(k, v)
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(body)

    do_GET = do_HEAD = answer

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def fetched(spark, urls, probe):
    spark.dataSource.register(web.WebFetch)
    return spark.read.format("webfetch").option("urls", json.dumps(urls)).option("probe", probe).load()


def test_links(spark, base):
    rows = fetched(spark, [f"{base}/{p}" for p in ("ok", "refuses", "busy", "gone", "soft", "moved", "loop")] + ["mailto:a@b"], "link")
    got = {r["url"].rpartition("/")[2]: (r["verdict"], r["reason"], r["hops"]) for r in web.live_checks(rows).collect()}
    assert got == {
        "ok": ("ok", None, 0), "refuses": ("ok", None, 0), "busy": ("ok", None, 0), "gone": ("broken", "HTTP 404", 0), "soft": ("warning", "soft-404", 0), "moved": ("redirect", None, 1), "loop": ("broken", "redirect loop", 1),
        "mailto:a@b": ("skipped", None, 0),
    }
    assert "GET/gone" not in Handler.seen


def test_icons_and_robots(spark, base):
    assert [tuple(r) for r in web.favicons(fetched(spark, [f"{base}/favicon.ico"], "icon")).collect()] == [(base, True)]
    assert [tuple(r) for r in web.favicons(fetched(spark, [f"{base}/other.ico"], "icon")).collect()] == [(base, False)]
    assert [tuple(r) for r in web.robots_files(fetched(spark, [f"{base}/robots.txt"], "page")).collect()] == [(base, f"{base}/robots.txt", 200, f"{base}/robots.txt", "User-agent: *")]


def test_waits():
    assert web.wait_before(0, "2") == 2 and web.wait_before(0, "600") == web.MOST_WAIT_S and web.wait_before(0, "-1") == 0
    assert web.wait_before(0, "Thu, 01 Jan 1970 00:00:11 GMT", now=10.0) == 1 and web.wait_before(0, "Thu, 01 Jan 1970 00:00:11 GMT", now=20.0) == 0
    assert web.WAIT_S <= web.wait_before(0, None) <= 2 * web.WAIT_S and web.wait_before(9, "soon") == web.MOST_WAIT_S
