"""Rows of the survey that were built in part before: chosen readings, wanted assets, metadata, orders, citations."""

import pytest
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U
from loomaudit.operators import coverage, extract, locales
from loomaudit.plans import producer, render, report
from loomaudit.sources import snapshot

A = "https://a.example"
FETCHES = "site string, page_url string, visit_ord bigint, status int, content_type string, headers map<string,string>, html string"


def declared(spark, **html):
    return extract.declared(extract.raw_pages(spark.createDataFrame([(A, f"{A}/{n}", 0, 200, "text/html", {}, h) for n, h in html.items()], FETCHES)))


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("static", {"full": ("Static", "static", False), "shell": (None, "static", False), "lost": (None, "static", False)}),
        ("auto", {"full": ("Static", "static", False), "shell": ("Late", "headless", False), "lost": (None, "static", True)}),
        ("headless", {"full": ("Rendered", "headless", False), "shell": ("Late", "headless", False), "lost": (None, "static", True)}),
    ],
)
def test_readings_are_chosen_by_mode(spark, mode, want):
    static = declared(spark, full="<title>Static</title>", shell="<div id=app></div>", lost="<div id=app></div>")
    rendered = declared(spark, full="<title>Rendered</title>", shell="<title>Late</title>")
    got = {r["page_url"].rpartition("/")[2]: (r["title"], r["mode"], r["escalation_blocked"] is not None) for r in extract.inspected(static, rendered, mode).collect()}
    assert got == want
    if mode == "auto":
        alone = extract.inspected(static, None, mode)
        assert {r["page_url"].rpartition("/")[2] for r in alone.where("escalation_blocked is not null").collect()} == {"shell", "lost"}
        assert report.blocked_escalations(alone).first()["pages"] == 2
    delta = {(r["side"], r["page_url"].rpartition("/")[2]) for r in extract.hydration_delta(extract.raw_pages(spark.createDataFrame([(A, f"{A}/x", 0, 200, "text/html", {}, "<meta name=a content=1>")], FETCHES)), extract.raw_pages(spark.createDataFrame([(A, f"{A}/x", 0, 200, "text/html", {}, "<meta name=b content=1>")], FETCHES))).collect()}
    assert delta == {("static", "x"), ("rendered", "x")}
    with pytest.raises(ValueError):
        extract.inspected(static, None, "other")


def test_wanted_assets(spark):
    pages = declared(spark, p=f"<meta property=og:image content='{A}/1.png'><meta property=og:image content='/2.png'><meta property=og:image content=' https://cdn.example/3.png '><meta property=og:image content='data:x'><link rel=icon href=/i.png>")
    assert {r["url"] for r in snapshot.wanted_assets(pages).collect()} == {f"{A}/1.png", "https://cdn.example/3.png", f"{A}/i.png"}
    assert {r["url"] for r in snapshot.wanted_assets(pages, external=False).collect()} == {f"{A}/1.png", f"{A}/i.png"}


def test_page_metadata(spark):
    entries = spark.createDataFrame([("b", "one", "en", "/en/one", True, None), ("b", "one", "pt-br", "/pt-br/um", True, None), ("b", "two", "en", "/en/two", True, None)], "family string, key string, locale string, path string, listed boolean, last_modified string")
    content = spark.createDataFrame([("/en/one", "One", "About one", "/card.png", None), ("/pt-br/um", "Um", "Sobre um", "https://cdn.example/c.png", "Um cartão"), ("/en/two", "Two", None, None, None)], "path string, title string, description string, image string, image_alt string")
    got = {r["path"]: r for r in producer.page_metadata(producer.registry(entries, "en"), content, "https://a.example/", "Site").collect()}
    one, um, two = got["/en/one"], got["/pt-br/um"], got["/en/two"]
    assert one["languages"] == {"en": f"{A}/en/one", "pt-BR": f"{A}/pt-br/um", "x-default": f"{A}/en/one"} and one["og_locale"] == "en_US" and one["og_alternates"] == ["pt_BR"]
    assert (one["og_image"], one["og_image_alt"], one["twitter_card"], one["twitter_title"]) == (f"{A}/card.png", "One", "summary_large_image", "One")
    assert (um["og_image"], um["og_image_alt"], um["og_url"], um["og_alternates"]) == ("https://cdn.example/c.png", "Um cartão", f"{A}/pt-br/um", ["en_US"])
    assert two["languages"] is None and two["og_image"] is None and two["twitter_card"] == "summary" and two["og_alternates"] == []


def test_first_message_and_pages_by_broken_links(spark):
    findings = spark.createDataFrame([("i2", "seo", "r", "warning", "https://b", "second"), ("i1", "seo", "r", "error", "https://a", "first"), ("i3", "seo", "q", "info", "https://a", "only")], "id string, kind string, rule_id string, severity string, page_url string, summary string")
    assert {r["rule_id"]: (r["severity"], r["findings"], r["first"]) for r in report.rollup_by_rule(findings).collect()} == {"r": ("error", 2, "first"), "q": ("info", 1, "only")}
    broken = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "y"), ("a", "y"), ("c", "x")], "page_url string, url string")
    assert [tuple(r) for r in report.pages_by_broken(broken).collect()] == [("a", 2), ("b", 1), ("c", 1)]


def test_holes_that_routes_hide(spark):
    cells = spark.createDataFrame([(A, f"/legal/{i}", "en", "u") for i in range(3)] + [(A, "/x", "en", "u"), (A, "/y", "fr", "u")], "site string, route string, locale string, url string")
    assert [tuple(r) for r in locales.hidden_holes(cells, ["/legal/**"]).collect()] == [(A, 3)]
    assert locales.holes(cells, ["/legal/**"]).count() == 2


def test_orders(spark):
    found = spark.createDataFrame([(A, "xx", 9, False, None, ""), (A, "fr", 2, True, True, "fr"), (A, "de", 5, True, False, "en"), (A, "es", 7, True, None, "")], "site string, tag string, pages int, known_language boolean, lang_agrees boolean, langs string")
    assert [r["tag"] for r in locales.by_evidence(found).collect()] == ["fr", "es", "de", "xx"]
    chosen = spark.createDataFrame([(A, "/a", 8, True)] * 2 + [(A, "/b", 9, True)] * 3, "site string, pattern string, size int, keep boolean")
    assert [r["pattern"] for r in coverage.families(chosen).collect()] == ["/b", "/a"]


def test_citations(spark):
    rules = spark.createDataFrame([("r1", "a,b"), ("r2", "a,gone"), ("r3", "")], "rule_id string, sources string")
    sources = spark.createDataFrame([("a", "https://a"), ("b", "https://b"), ("idle", "https://c")], "id string, url string")
    found, dangling, idle = (sorted(tuple(r) for r in x.collect()) for x in render.cited(rules, sources))
    assert found == [("r1", "a", "https://a"), ("r1", "b", "https://b"), ("r2", "a", "https://a")] and dangling == [("r2", "gone")] and idle == [("idle",)]


def test_safe_urls_and_clips(spark):
    urls = spark.createDataFrame([("HTTPS://A.example/x y",), ("javascript:alert(1)",), ("/rel",), ("data:text/html,x",), (None,)], "u string")
    assert [r[0] for r in urls.select(U.safe_url(F.col("u"))).collect()] == ["https://a.example/x%20y", None, None, None, None]
    assert [r[0] for r in spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string").select(X.clipped(F.col("t"), 3)).collect()] == ["abc…", "abc", None]
