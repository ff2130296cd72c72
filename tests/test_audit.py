import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from loomaudit.operators import crawl, extract
from loomaudit.plans import audit, cards, render, report
from loomaudit.sources import web

A = "https://a.example"
FETCHES = "site string, page_url string, visit_ord bigint, status int, content_type string, headers map<string,string>, html string"


def page(path, title, *links, lang="en"):
    body = "".join(f'<a href="{x}">x</a>' for x in links)
    return (A, A + path, 0, 200, "text/html", {}, f'<html lang="{lang}"><head><title>{title}</title></head><body>{body}')


@pytest.fixture(scope="module")
def snap(spark):
    rows = [page("/en", "The home page", "/en/one", "/en/gone", "/fr", "https://b.example/"), page("/en/one", "Page one of many", "/en/two"), page("/en/two", "Page two of many"), page("/fr", "Accueil en français", lang="fr"), (A, f"{A}/en/gone", 0, 404, "text/html", {}, "")]
    robots = spark.createDataFrame([(A, f"{A}/robots.txt", 200, f"{A}/robots.txt", "User-agent: *\nDisallow: /fr\n")], "site string, url string, status int, final_url string, body string")
    sitemap = "<urlset>" + "".join(f"<url><loc>{A}{p}</loc></url>" for p in ("/en", "/en/one", "/fr")) + "</urlset>"
    responses = spark.createDataFrame([(A, f"{A}/sitemap.xml", 200, None, sitemap.encode())], "site string, url string, status int, location string, body binary")
    return audit.Snapshot(spark.createDataFrame(rows, FETCHES), robots=robots, responses=responses)


@pytest.fixture(scope="module")
def audited(snap):
    return audit.run_audit(snap, audit.Options(fail_on="error"))


def test_audit(audited):
    out = audited
    s = out["summary"].first()
    assert (s["site"], s["pages"], s["broken_links"], s["unreachable_pages"], s["verdict"], s["exit_code"]) == (A, 4, 1, 1, "red", 1)
    found = {(r["kind"], r["rule_id"]) for r in out["findings"].collect()}
    assert {("seo", "description.missing"), ("site", "hreflang.missing"), ("site", "sitemap.entry.blocked-by-robots"), ("site", "sitemap.orphans"), ("link", "broken"), ("page", "page.unreachable"), ("i18n", "hole")} <= found
    assert {r["route"]: r["missing"] for r in out["holes"].collect()} == {"/one": "fr", "/two": "fr"}
    assert {r["locale"] for r in out["matrix"].select("locale").distinct().collect()} == {"en", "fr"}
    assert "RED" in render.summary_text(out["summary"], out["findings"])
    html = render.preview_html(cards.cards(out["pages"]))
    assert html.count("<section>") == 28 and "français" in html


def test_same_audit_has_no_changes(audited):
    out = audited["findings"]
    changes = report.difference(out, out)
    assert {r["change"] for r in changes.select("change").distinct().collect()} == {"kept"}
    assert report.gate(changes, "warning").first()["exit_code"] == 0
    assert render.difference_text(changes, 3).startswith("0 added, 0 resolved")


def test_crawl(snap, spark):
    raw = extract.raw_pages(snap.fetches.where("status = 200"))
    answers = snap.fetches.select(F.col("page_url").alias("url"), "status", F.col("page_url").alias("final_url"))
    seeds = spark.createDataFrame([(A, f"{A}/en/")], "site string, url string")

    def visited(**options):
        return {r["url"].removeprefix(A): r["depth"] for r in crawl.crawl(seeds, raw, answers, **options)[0].collect()}

    assert visited(depth=0) == {"/en": 0}
    assert visited(depth=1) == {"/en": 0, "/en/one": 1, "/fr": 1}
    assert visited(depth=5) == {"/en": 0, "/en/one": 1, "/fr": 1, "/en/two": 2}
    assert visited(depth=5, exclude=["/en/one"]) == {"/en": 0, "/fr": 1}
    assert visited(depth=5, most_pages=2) == {"/en": 0, "/en/one": 1}


def test_audit_of_a_crawl_with_structure(snap, spark):
    out = audit.run_audit(snap, audit.Options(depth=1, coverage="structural", max_debt=0), spark.createDataFrame([(A, f"{A}/en")], "site string, url string"))
    assert out["pages"].count() == 3 and out["summary"].first()["exit_code"] == 1 and out["families"].count() == 0


def test_catalogue(spark):
    rules = json.loads(render.catalogue_json())["rules"]
    assert len(rules) == 58 and len({r["id"] for r in rules}) == 58
    sources = spark.createDataFrame([("a", "https://x", "2024-01-01", "q"), ("a", "http://x#f", "2024-02-31", "q" * 301)], "id string, url string, consulted string, quote string")
    assert {r["fault"] for r in render.source_faults(sources).collect()} == {"duplicate id", "not https", "has a fragment", "no real date", "long quote"}


@pytest.fixture(scope="module")
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            kind, _, to = self.path.strip("/").partition("-")
            self.send_response({"moved": 302, "loop": 302, "gone": 410}.get(kind, 200))
            if kind in ("moved", "loop"):
                self.send_header("Location", "/ok" if kind == "moved" else "/loop")
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(f"<title>{kind}{to}</title>".encode())

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_web_source(spark, server):
    spark.dataSource.register(web.WebFetch)
    urls = [f"{server}/{p}" for p in ("ok", "moved", "loop", "gone")] + ["http://127.0.0.1:1/", "mailto:a@b"]
    got = {r["requested_url"].rpartition("/")[2]: r for r in spark.read.format("webfetch").option("urls", json.dumps(urls)).load().collect()}
    assert (got["ok"]["status"], got["ok"]["html"], got["ok"]["site"]) == (200, "<title>ok</title>", server)
    assert (got["moved"]["redirect_count"], got["moved"]["page_url"]) == (1, f"{server}/ok")
    assert (got["loop"]["status"], got["loop"]["reason"], got["gone"]["status"]) == (0, "redirect loop", 410)
    assert got[""]["reason"] == "network" and got["mailto:a@b"]["reason"] == "not an http(s) URL"
