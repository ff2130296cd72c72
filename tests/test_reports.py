"""Reports, rules of one's own and the producing side: what the catalogue's tables do not show."""

import pytest
from pyspark.sql import functions as F

from loomaudit.operators import links
from loomaudit.plans import options, page_rules, producer, report


def test_a_rule_that_raises_leaves_the_others_alone(spark):
    pages = spark.createDataFrame([("s", "u", 0, "t"), ("s", "v", 1, None)], "site string, page_url string, visit_ord bigint, title string")

    def judge(page):
        if page["title"] is None:
            raise KeyError("title")
        return "warn", 1

    rules = [page_rules.own_rule("a", "warning", ("title",), judge), page_rules.own_rule("b", "error", ("title",), lambda page: "fail"), page_rules.own_rule("c", "error", ("title",), lambda page: "maybe")]
    got = {(r["page_url"], r["rule_id"]): (r["status"], r["severity"], r["observed"]) for r in page_rules.evaluate(pages, rules).collect()}
    assert got["u", "a"] == ("warn", None, "1") and got["v", "a"] == ("crashed", "info", "'title'")
    assert got["u", "b"] == got["v", "b"] == ("fail", "error", None)
    assert got["u", "c"] == ("crashed", "info", "no status: 'maybe'")
    found = report.page_findings(page_rules.evaluate(pages, rules)).collect()
    assert sorted((r["rule_id"], r["page_url"]) for r in found) == [("b", "u"), ("b", "v"), *[("engine.rule-crashed", x) for x in ("u", "v", "v")]]
    assert len({r["id"] for r in found}) == 5


def test_exit_codes(spark):
    rows = spark.createDataFrame([("red", False), ("yellow", False), ("green", False), ("green", True), ("red", True)], "verdict string, fatal boolean")
    codes = lambda fail_on: [r[0] for r in rows.select(report.exit_code(F.col("verdict"), fail_on, F.col("fatal"))).collect()]
    assert codes("error") == [1, 0, 0, 2, 2] and codes("warning") == [1, 1, 0, 2, 2] and codes("never") == [0, 0, 0, 2, 2]


def test_a_sitemap_that_does_not_answer_is_fatal(spark):
    rows = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, False)], "site string, unreachable boolean, found boolean")
    assert [r["site"] for r in report.fatal_sites(rows).collect()] == ["a"]


def test_scan_warnings(spark):
    rows = [("blind", False)] * 2 + [("half", False), ("half", True), ("few", False), ("few", True), ("few", True), ("none", True), ("blind", None)]
    got = {r["site"]: (r["failed"], r["warning"]) for r in report.scan_warnings(spark.createDataFrame(rows, "site string, scanned boolean")).collect()}
    assert got == {"blind": (3, "blind"), "half": (1, "partial")}


def test_siblings(spark):
    rows = [("s", "s/en/a", "/en/a"), ("s", "s/fr/a", "/fr/a"), ("s", "s/de/a", "/de/a"), ("s", "s/en/b", "/en/b"), ("t", "t/fr/a", "/fr/a")]
    got = report.siblings(spark.createDataFrame(rows, "site string, page_url string, path string")).collect()
    assert {(r["page_url"], r["locale"]) for r in got} == {("s/en/a", "fr"), ("s/en/a", "de"), ("s/fr/a", "en"), ("s/fr/a", "de"), ("s/de/a", "en"), ("s/de/a", "fr")}


@pytest.mark.parametrize(
    ("given", "key"),
    [
        ({"kind": "title"}, "title"),
        ({"kind": "meta", "property": "og:title", "name": "x"}, "meta:property:og:title"),
        ({"kind": "meta", "http_equiv": "refresh", "name": "x"}, "meta:http-equiv:refresh"),
        ({"kind": "meta", "name": "robots"}, "meta:name:robots"),
        ({"kind": "meta"}, "meta:unknown"),
        ({"kind": "link", "rel": "icon"}, "link:rel:icon"),
        ({"kind": "html", "attribute": "lang"}, "html:lang"),
        ({"kind": "json-ld", "index": 2, "path": "@type"}, "json-ld:2:@type"),
        ({"kind": "header", "name": "X-Robots-Tag"}, "header:x-robots-tag"),
        ({"kind": "computed"}, "computed"),
    ],
)
def test_origin_keys(spark, given, key):
    names = ("kind", "property", "http_equiv", "name", "rel", "attribute", "index", "path")
    assert spark.range(1).select(report.origin_key(*(F.lit(given.get(n)).cast("string") for n in names))).first()[0] == key


def test_asset_failures_and_link_order(spark):
    said = lambda s, t: spark.range(1).select(report.asset_failure(F.lit(s), F.lit(t).cast("string"))).first()[0]
    assert said(0, None) == "the request failed" and said(404, "x") == "HTTP 404" and said(200, "text/html") == "HTTP 200 with text/html, not an image" and said(200, None) == "HTTP 200 with no content type, not an image"
    rows = [("u1", "ok", 9), ("u2", "broken", 1), ("u4", "broken", 2), ("u3", "broken", 2), ("u5", "skipped", 50), ("u6", "warning", 1)]
    shown = spark.createDataFrame([(u, v, "k", "h", n) for u, v, n in rows], "url string, verdict string, kind string, host string, references int")
    assert [r["url"] for r in links.ordered(shown).collect()] == ["u3", "u4", "u2", "u6", "u1", "u5"]


def test_options_are_listed(spark):
    got = {r["name"]: r["default"] for r in options.catalogue(spark).collect()}
    assert got["--fail-on"] == "warning" and got["--max-pages"] == "200"


def test_site_definition(spark):
    got = [tuple(r) for r in producer.site_definition(spark, "https://a.example/", ["en", "pt-br"], "en").collect()]
    assert got == [("https://a.example", "en", "en", "en_US", True), ("https://a.example", "pt-br", "pt-BR", "pt_BR", False)]


@pytest.mark.parametrize(
    ("base", "served", "default"),
    [("a.example", ["en"], "en"), ("ftp://a.example", ["en"], "en"), ("https://a.example/x", ["en"], "en"), ("https://a.example/?q", ["en"], "en"), ("https://a.example", [], "en"), ("https://a.example", ["en", "en"], "en"), ("https://a.example", ["en"], "fr"), ("https://a.example", ["en", "und"], "en")],
)
def test_wrong_sites_are_refused(spark, base, served, default):
    with pytest.raises(ValueError):
        producer.site_definition(spark, base, served, default)


def test_collections_registries_and_root(spark):
    posts = spark.createDataFrame([("a", "fr", "2024-01-01", None), ("b", "en", None, False)], "slug string, lang string, changed string, shown boolean")
    rows = producer.collection(posts, "blog", F.concat(F.lit("/"), "lang", F.lit("/"), "slug"), F.col("lang"), listed=F.col("shown"), last_modified=F.col("changed"))
    assert [tuple(r) for r in rows.collect()] == [("blog", "/fr/a", "fr", "/fr/a", True, "2024-01-01"), ("blog", "/en/b", "en", "/en/b", False, None)]
    assert producer.checked_registry(rows, "en").count() == 2
    with pytest.raises(ValueError, match="shared-path: /en/b"):
        producer.checked_registry(rows.unionByName(rows.withColumn("family", F.lit("other"))), "en")
    root = producer.root_metadata(spark, "https://a.example/", "A site", "About", False).first()
    assert (root["metadata_base"], root["title_template"], root["indexable"]) == ("https://a.example", "%s · A site", False)
