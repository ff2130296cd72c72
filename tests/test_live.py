"""Fetching as an operator and live crawls, against servers of this test's own."""

import http.server
import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomaudit.operators import crawl, links
from loomaudit.plans import audit, live
from loomaudit.sources import fetching, sitemaps

PAGES = {
    "/": ["/a", "/b", "/c", "/old-b"], "/a": ["/a/1", "/a/2"], "/b": ["/a", "/b/1"], "/c": ["/gone", "/flaky"], "/a/1": ["/deep"], "/a/2": [], "/b/1": ["https://elsewhere.invalid/"], "/deep": ["/deeper"], "/deeper": [], "/flaky": ["/a"], "/lone": [], "/lone2": [],
}


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (1200).to_bytes(4, "big") + (630).to_bytes(4, "big")


class Site(http.server.BaseHTTPRequestHandler):
    log: list[tuple[float, str]] = []
    sitemap: str | None = None

    def do_GET(self):
        path = self.path
        times = sum(p == path for _, p in Site.log)
        Site.log.append((time.monotonic(), path))
        status, body, kind, more = 404, b"nothing", "text/html", {}
        if path == "/flaky" and times == 0 or path == "/dead":
            self.connection.close()
            return
        if path == "/old-b":
            status, more = 301, {"Location": "/b"}
        elif path == "/robots.txt":
            status, kind, body = 200, "text/plain", b"User-agent: *\nDisallow: /nothing\n"
        elif path == "/card.png":
            status, kind, body = (206 if self.headers.get("Range") else 200), "image/png", PNG + b"x" * 100_000
            body = body[:8192] if status == 206 else body
        elif path == "/site.json":
            status, kind, body = 200, "application/manifest+json", b'{"icons": [{"src": "/none.png", "sizes": "64x64"}]}'
        elif path == "/dressed":
            status, body = 200, b"<html lang=en><head><title>A page that is dressed</title><meta property=og:image content='http://" + self.headers["Host"].encode() + b"/card.png'><meta property=og:image:width content=10><meta property=og:image:height content=20><link rel=icon href=/none.png sizes=16x16><link rel=manifest href=/site.json></head></html>"
        elif path == "/sitemap.xml" and Site.sitemap:
            status, kind, body = 200, "application/xml", Site.sitemap.encode()
        elif path in PAGES or path.startswith("/many/"):
            links_ = "".join(f'<a href="{x}">x</a>' for x in PAGES.get(path, ()))
            status, body = 200, f"<html lang=en><head><title>The page {path} of a site</title></head><body>{links_}</body></html>".encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        for k, v in more.items():
            self.send_header(k, v)
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(body)

    do_HEAD = do_GET

    def log_message(self, *args):
        pass


@pytest.fixture()
def site():
    Site.log, Site.sitemap = [], None
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    server.daemon_threads = True
    server.request_queue_size = 128
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_thousands_of_urls_keep_their_columns_and_pass_no_driver(spark, site):
    urls = spark.range(5000).select(F.col("id").alias("n"), F.concat(F.lit(f"{site}/many/"), F.col("id").cast("string")).alias("requested_url"), F.lit("x").alias("Answer"))
    got = fetching.fetched(urls, timeout=10)
    assert got.columns == ["n", "requested_url", "answer"]
    out = got.select("n", "answer.status", "answer.page_url", "answer.attempts").collect()
    assert len(out) == 5000 and {r["status"] for r in out} == {200} and {r["attempts"] for r in out} == {1}
    assert all(r["page_url"] == f"{site}/many/{r['n']}" for r in out)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small table of URLs is still many tasks' work


def test_failures_are_asked_again_behind_everything_else(spark, site):
    urls = spark.createDataFrame([(f"{site}{p}",) for p in ("/flaky", "/dead", *(f"/many/{i}" for i in range(40)))] + [(None,), ("mailto:x@y",), ("http://host.invalid:99999/",)], "requested_url string")
    out = {r["requested_url"]: r["answer"] for r in fetching.fetched(urls, timeout=5, lanes=1).collect()}
    assert (out[f"{site}/flaky"]["status"], out[f"{site}/flaky"]["attempts"]) == (200, 2)
    assert (out[f"{site}/dead"]["status"], out[f"{site}/dead"]["attempts"]) == (0, 2)
    assert out[None]["status"] == 0 and out[None]["attempts"] == 1 and out["mailto:x@y"]["reason"] == "not an http(s) URL" and out["http://host.invalid:99999/"]["status"] == 0
    order = [p for _, p in Site.log]
    last_first_try = max(i for i, p in enumerate(order) if p.startswith("/many/"))
    assert all(order.count(p) == 2 and max(i for i, x in enumerate(order) if x == p) > last_first_try for p in ("/flaky", "/dead"))


def test_a_host_is_paced_over_all_its_lanes(spark, site):
    urls = spark.range(12).select(F.concat(F.lit(f"{site}/many/"), F.col("id").cast("string")).alias("requested_url"))
    began = time.monotonic()
    assert fetching.fetched(urls, pace_s=0.1, lanes=3).count() == 12
    assert time.monotonic() - began >= 0.1 * 12 / 3  # the fullest lane has a third or more, 0.3 s apart


def test_unknown_probe(spark):
    with pytest.raises(ValueError):
        fetching.fetched(spark.range(1).select(F.lit("x").alias("requested_url")), probe="other")


def crawled(spark, site, path="/", **how):
    out = crawl.live(spark.createDataFrame([(site, f"{site}{path}", 0)], "site string, url string, ord int"), fetching.asking(timeout=5), **how)
    return {k: v.collect() for k, v in out.items()}


def test_live_crawl_follows_levels_retries_and_keeps_each_document_once(spark, site):
    out = crawled(spark, site, depth=2)
    visited = {r["final_url"].removeprefix(site): r["depth"] for r in out["visited"]}
    assert visited == {"/": 0, "/a": 1, "/b": 1, "/c": 1, "/a/1": 2, "/a/2": 2, "/b/1": 2, "/flaky": 2}  # /old-b ends at /b, /deep is a level too far
    assert [r["url"].removeprefix(site) for r in out["recovered"]] == ["/flaky"] and out["errors"] == [] and out["truncated"] == []
    pages = [r["page_url"].removeprefix(site) for r in out["fetches"]]
    assert pages.count("/b") == 1 and "/gone" in pages and len(pages) == 9
    assert sorted(r["place"] for r in out["visited"]) == list(range(1, 9))


def test_a_budget_of_pages_cuts_in_the_order_of_links(spark, site):
    out = crawled(spark, site, depth=3, most_pages=4)
    assert {r["final_url"].removeprefix(site) for r in out["visited"]} == {"/", "/a", "/b", "/c"}
    assert [r["site"] for r in out["truncated"]] == [site]
    assert not any(p.startswith("/a/") for _, p in Site.log)  # what cannot be kept is not asked for


def test_filters_and_a_start_that_does_not_answer(spark, site):
    out = crawled(spark, site, depth=2, include=["/a*", "/a/**"])
    assert {r["final_url"].removeprefix(site) for r in out["visited"]} <= {"/", "/a", "/a/1", "/a/2"}
    out = crawled(spark, site, "/dead")
    assert out["visited"] == [] and out["fetches"] == [] and [r["reason"] for r in out["errors"]] == ["network"]


def test_fallback_entries(spark, site):
    sites = spark.createDataFrame([(site, f"{site}/")], "site string, url string")
    none = sites.limit(0)
    _, entries, said = sitemaps.discover(sites, none.select("site", "url", F.lit(0).alias("line")), none.select("site", "url", F.lit(200).alias("status"), F.lit(b"").alias("body")))
    found, now = sitemaps.or_crawled(sites, entries, said, lambda seeds: crawl.live(seeds, fetching.asking(timeout=5), depth=1, most_pages=100)["visited"])
    assert {r["loc"].removeprefix(site) for r in found.collect()} == {"/", "/a", "/b", "/c"}
    assert [(r["source"], r["urls"]) for r in now.collect()] == [("crawl", 4)]


def test_entries_are_probed_within_a_budget(spark, site):
    listed = spark.createDataFrame([(site, f"{site}{p}", i) for i, p in enumerate(("/a", "/b", "/lone", "/none", "/lone2", "/c"))], "site string, loc string, ord int")
    crawl_ = spark.createDataFrame([(f"{site}/a", 200)], "page_url string, status int")
    linked = spark.createDataFrame([(f"{site}/b", 200, f"{site}/b2")], "url string, status int, final_url string")
    probes, unprobed = links.probed_entries(listed, crawl_, linked, fetching.asking("link", timeout=5), budget=3)
    assert {(r["loc"].removeprefix(site), r["status"], r["via"]) for r in probes.collect()} == {("/a", 200, "crawl"), ("/b", 200, "link-audit"), ("/lone", 200, "probe"), ("/none", 404, "probe"), ("/lone2", 200, "probe")}
    assert [(r["site"], r["entries"]) for r in unprobed.collect()] == [(site, 1)]
    assert "/c" not in [p for _, p in Site.log]


def audited(spark, site, **options):
    return live.run_live_audit(spark.createDataFrame([(f"{site}/",)], "url string"), audit.Options(**options), timeout=5)


def test_live_audit_without_a_sitemap_crawls(spark, site):
    out = audited(spark, site, depth=1, check_external=False)
    assert {r["page_url"].removeprefix(site) for r in out["pages"].collect()} == {"/", "/a", "/b", "/c"}
    assert "sitemap.missing" in {r["rule_id"] for r in out["findings"].collect()}
    # The link check asks for what the crawl did not: /gone is broken, /old-b moved.
    verdicts = {r["url"].removeprefix(site): r["verdict"] for r in out["links"].collect()}
    assert (verdicts["/gone"], verdicts["/old-b"], verdicts["/a/1"]) == ("broken", "redirect", "ok")


def test_live_audit_probes_what_a_sitemap_lists(spark, site):
    Site.sitemap = "<urlset>" + "".join(f"<url><loc>{site}{p}</loc></url>" for p in ("/a", "/lone", "/none")) + "</urlset>"
    out = audited(spark, site, depth=0, check_external=False)
    assert {r["page_url"].removeprefix(site) for r in out["pages"].collect()} == {"/", "/a", "/lone"}
    assert {r["rule_id"] for r in out["findings"].collect()} >= {"sitemap.entry.unreachable"}
    seen = defaultdict(int)
    for _, p in Site.log:
        seen[p] += 1
    assert seen["/a"] == 1 and seen["/sitemap.xml"] == 1


def test_assets_are_read_by_their_first_bytes(spark, site):
    urls = spark.createDataFrame([(f"{site}/card.png",), (f"{site}/none.png",)], "requested_url string")
    got = {r["requested_url"].removeprefix(site): r["answer"] for r in fetching.fetched(urls, "asset", timeout=5).collect()}
    assert got["/card.png"]["status"] == 206 and len(got["/card.png"]["head"]) == 8192 and got["/none.png"]["status"] == 404


def test_live_audit_probes_images_icons_and_manifests(spark, site):
    PAGES["/"].append("/dressed")
    try:
        out = audited(spark, site, depth=1, check_external=False)
    finally:
        PAGES["/"].remove("/dressed")
    rules = {r["rule_id"] for r in out["findings"].where(F.col("page_url") == f"{site}/dressed").collect()}
    assert {"og.image.sizes-mismatch", "icons.unreachable"} <= rules and "og.image.reachable" not in rules
    assert "icons.manifest-mismatch" in rules
