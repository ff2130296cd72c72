import pytest
from pyspark.sql import functions as F

from loomaudit.operators import coverage, extract, links, locales, robots
from loomaudit.plans import page_rules, report, site_rules
from loomaudit.sources import snapshot

A = "https://a.example"


def declared(spark, html, headers=None, url=f"{A}/fr/page"):
    row = [(A, url, 0, 200, "text/html", headers or {}, html)]
    return extract.declared(extract.raw_pages(spark.createDataFrame(row, "site string, page_url string, visit_ord bigint, status int, content_type string, headers map<string,string>, html string")))


def statuses(pages):
    return {r["rule_id"]: r["status"] for r in page_rules.evaluate(pages).collect()}


RICH_PAGE = """<html lang="fr"><head><title> Un  titre </title><title>Other</title><base href="https://a.example/deep/">
<meta name="Description" content="first"><meta name="description" content="A description that is long enough to be judged an ideal one for a result list.">
<meta name="viewport" content="width=device-width"><meta name="robots" content="noindex, follow"><meta name="googlebot" content="index">
<meta property="og:title" content="Card"><meta property="og:image:width" content="9"><meta property="og:image" content="https://a.example/1.png"><meta property="og:image:width" content="1200px"><meta property="og:image:height" content="630"><meta property="og:image:alt" content="Card">
<meta property="og:image" content="/2.png"><meta property="og:locale" content="fr_FR"><meta property="og:locale:alternate" content="en_US">
<link rel="canonical" href="../page?x=1"><link rel="alternate" hreflang="en" href="/en/page"><link rel="alternate" hreflang="fr-FR" href="/fr/page"><link rel="icon" href="/i.png" sizes="32x32 any junk" type="image/png"><link rel="manifest" href="/m.json">
<script type="application/ld+json">{"@graph": [{"@type": "Article", "author": {"@type": ["Person", "Thing"]}}]}</script><script type="application/ld+json">{broken</script></head><body><a href="x#frag" rel="NoFollow me">Go <b>there</b></a><a href="mailto:a@b">m</a><img src="/p.png"></body></html>"""


def rich_page(spark):
    """A literal page that declares something of everything."""
    return declared(spark, RICH_PAGE, {"x-robots-tag": "noindex"})


def test_rich_page(spark):
    pages = rich_page(spark)
    p = pages.first()
    assert (p["title"], p["html_lang"], p["canonical"], p["canonical_raw"]) == ("Un titre", "fr", "https://a.example/page?x=1", "../page?x=1")
    assert p["description"].startswith("A description") and p["og_alternates"] == ["en_US"] and [i["parsed"] for i in p["icons"]] == [["32x32", "any"]]
    assert [(a["url"], a["fragment"], a["text"]) for a in p["anchors"] if a["tag"] == "a"] == [("https://a.example/deep/x", "frag", "Go there"), ("mailto:a@b", None, "m")]
    got = statuses(snapshot.without_probes(pages))
    assert len(got) == 25
    failed = {k for k, v in got.items() if v == "fail"}
    assert failed == {"canonical.absolute", "og.description.missing", "og.image.absolute", "og.image.alt", "og.image.alt.caption", "og.image.dimensions", "icons.apple-touch.missing", "robots.conflict"}
    assert got["title.length"] == "warn" and got["og.image.ratio"] == "pass" and got["og.locale.alternates"] == "pass" and got["og.image.reachable"] == "na"


def test_probe_rules(spark):
    pages = rich_page(spark)
    probes = spark.createDataFrame([(f"{A}/1.png", 200, True, "image/png", [(600, 315)]), (f"{A}/i.png", 404, False, "text/html", [])], "url string, status int, ok boolean, content_type string, sizes array<struct<width: int, height: int>>")
    manifests = spark.createDataFrame([(f"{A}/m.json", 200, '{"icons": [{"src": "/i.png", "sizes": "64x64"}]}')], "href string, status int, body string")
    got = statuses(snapshot.with_probes(pages, probes, manifests))
    assert (got["og.image.reachable"], got["og.image.sizes-mismatch"], got["icons.unreachable"], got["icons.manifest-mismatch"], got["icons.sizes-mismatch"]) == ("pass", "fail", "fail", "fail", "na")


@pytest.mark.parametrize(("html", "rule", "status"), [("", "title.missing", "fail"), ("<title>x</title>", "title.length", "warn"), ("", "title.length", "na"), ("<svg><title>no</title></svg><title>Yes it is one</title>", "title.missing", "pass"), ("<title>" + "é" * 65 + "</title>", "title.length", "warn"), (None, "icons.missing", "fail")])
def test_single(spark, html, rule, status):
    assert statuses(snapshot.without_probes(declared(spark, html)))[rule] == status


def test_bands_and_profiles(spark):
    pages = snapshot.without_probes(declared(spark, "<title>" + "x" * 65 + "</title>"))
    row = page_rules.evaluate(pages).where("rule_id = 'title.length'").first()
    assert (row["band"], row["severity"]) == ("acceptable", "warning")
    strict = {r.id: r for r in page_rules.under_profile(page_rules.page_rules(), "strict")}
    assert strict["canonical.missing"].severity == "error" and strict["title.length"].severities == {"acceptable": "warning", "poor": "warning"}
    assert "title.length" not in {r.id for r in page_rules.under_profile(page_rules.page_rules(), "spec-only")}
    with pytest.raises(ValueError, match="unknown profile"):
        page_rules.profile_named("nope")
    assert page_rules.rule_table(spark).count() == 25


def test_own_rule(spark):
    own = page_rules.Rule("own", "heuristic", "x", F.when(F.col("title").contains("x"), "fail").otherwise("pass"), F.col("title"), "info")
    assert page_rules.evaluate(snapshot.without_probes(declared(spark, "<title>x</title>")), [own]).first()["severity"] == "info"


@pytest.mark.parametrize(
    ("body", "path", "agent", "allowed"),
    [
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", "*", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", "*", True),
        ("User-agent: *\nDisallow: /*.pdf$", "/x.pdf?y", "*", True),
        ("User-agent: *\nDisallow: /*.pdf$", "/x.pdf", "*", False),
        ("User-agent: *\nDisallow: /caf%C3%A9", "/café", "*", False),
        ("User-agent: *\nDisallow: /a+b(", "/a+b(c", "*", False),
        ("User-agent: bot\nDisallow: /\nUser-agent: *\nAllow: /", "/x", "Bot/2.1", False),
        ("User-agent: bot\nDisallow: /", "/x", "*", True),
        ("User-agent: bot\nUser-agent: other\nDisallow: /x\n\nUser-agent: bot\nDisallow: /y", "/y", "bot", False),
        ("User-agent: *\nDisallow:", "/x", "*", True),
        ("Disallow: /", "/x", "*", True),
        ("", "/x", "*", True),
        (None, "/x", "*", True),
    ],
)
def test_robots(spark, body, path, agent, allowed):
    said = robots.lines(spark.createDataFrame([(A, body)], "site string, body string"))
    asked = spark.createDataFrame([(A, path)], "site string, path string")
    assert robots.decisions(asked, said, agent).first()["allowed"] is allowed


def test_link_checks(spark):
    urls = [f"{A}/{x}" for x in ("ok", "moved", "loop", "gone", "soft", "blocked", "absent")] + ["mailto:a@b"]
    answers = [("ok", 200, None, "fine"), ("moved", 302, f"{A}/ok", ""), ("loop", 302, f"{A}/loop2", ""), ("loop2", 302, f"{A}/loop", ""), ("gone", 410, None, ""), ("soft", 200, None, "Page not found"), ("blocked", 429, None, "")]
    known = spark.createDataFrame([(f"{A}/{u}", s, to, b) for u, s, to, b in answers], "url string, status int, location string, body string")
    got = {r["url"].removeprefix(f"{A}/"): r["verdict"] for r in links.checks(spark.createDataFrame([(u,) for u in urls], "url string"), known).collect()}
    assert got == {"ok": "ok", "moved": "redirect", "loop": "broken", "gone": "broken", "soft": "warning", "blocked": "blocked", "absent": "broken", "mailto:a@b": "skipped"}


def test_site_rules(spark):
    pages = declared(spark, '<title>x</title><meta name="robots" content="index">', url=f"{A}/fr/secret").withColumns({"path": F.lit("/fr/secret"), "path_query": F.lit("/fr/secret")})
    said = robots.lines(spark.createDataFrame([(A, "User-agent: *\nDisallow: /fr/\nSitemap: /sitemap.xml\nFoo: 1")], "site string, body string"))
    entries = spark.createDataFrame([(A, f"{A}/sitemap.xml", f"{A}/fr/secret", None, None, None, [], 1), (A, f"{A}/sitemap.xml", "nope", "2999-01-01", "often", None, [], 2)], "site string, document_url string, loc string, lastmod string, changefreq string, priority string, alternates array<struct<hreflang: string, href: string>>, ord int")
    site = site_rules.Site(
        pages, F.lit("2026-01-01").cast("timestamp"), said=said, entries=entries,
        robots=spark.createDataFrame([(A, f"{A}/robots.txt", 200, f"{A}/robots.txt", 600_000)], "site string, url string, status int, final_url string, bytes bigint"),
        sitemaps=spark.createDataFrame([(A, True, 2, 1, False)], "site string, found boolean, urls bigint, child_errors bigint, unparsable boolean"),
        documents=spark.createDataFrame([(A, f"{A}/sitemap.xml", 50_001, 10)], "site string, url string, entries bigint, bytes bigint"),
        axis=spark.createDataFrame([(A, "fr"), (A, "en")], "site string, locale string"),
        probes=spark.createDataFrame([(A, "nope", 404, "nope")], "site string, loc string, status int, final_url string"), favicons=spark.createDataFrame([(A, False)], "site string, found boolean"),
    )
    got = {r["rule_id"] for r in site_rules.evaluate(site).collect()}
    assert got == {"hreflang.missing", "icons.ico.missing", "robots.blocks-page", "robotstxt.invalid-line", "robotstxt.oversized", "robotstxt.sitemap.relative", "sitemap.entry.blocked-by-robots", "sitemap.entry.invalid-url", "sitemap.entry.unreachable", "sitemap.field.invalid", "sitemap.index.child-error", "sitemap.lastmod.invalid", "sitemap.limits.exceeded"}
    assert len(site_rules.RULES) == 28 and site_rules.evaluate(site_rules.Site(pages, F.current_timestamp())).count() == 0


def test_ids_do_not_depend_on_the_origin(spark):
    def ids(origin):
        pages = snapshot.without_probes(declared(spark, "", url=f"{origin}/x")).withColumn("site", F.lit(origin))
        return {r["id"] for r in report.page_findings(page_rules.evaluate(pages)).collect()}

    assert ids(A) == ids("http://localhost:3000")


def test_summary_and_gate(spark):
    sites = spark.createDataFrame([(A,), ("https://b.example",)], "site string")
    found = spark.createDataFrame([("1", "seo", "r", "warning", "p", "s", A)], "id string, kind string, rule_id string, severity string, page_url string, summary string, site string")
    got = {r["site"]: r["verdict"] for r in report.summary(sites, spark.createDataFrame([(A,)], "site string"), found).collect()}
    assert got == {A: "yellow", "https://b.example": "red"}
    changes = report.difference(found.where("false"), found)
    assert report.gate(changes, "error").first()["exit_code"] == 0 and report.gate(changes, "warning").first()["exit_code"] == 1


def test_coverage_does_not_depend_on_order(spark):
    rows = [(A, f"{A}/blog/{i:02}", f"/blog/{i:02}") for i in range(12)] + [(A, f"{A}/about", "/about"), (A, f"{A}/", "/")]
    for order in (rows, rows[::-1]):
        chosen = coverage.selected(coverage.patterned(spark.createDataFrame(order, "site string, url string, path string")))
        kept = {r["url"].removeprefix(A) for r in chosen.where("keep").collect()}
        assert kept == {"/blog/00", "/blog/06", "/blog/11", "/about", "/"}


def test_holes_ignore_routes(spark):
    cells = spark.createDataFrame([(A, "/legal", "en", "u"), (A, "/legal", "fr", None)], "site string, route string, locale string, url string")
    assert locales.holes(cells).count() == 1 and locales.holes(cells, ["/legal"]).count() == 0


def test_hydration(spark):
    def raw(html):
        row = [(A, f"{A}/x", 0, 200, "text/html", {}, html)]
        return extract.raw_pages(spark.createDataFrame(row, "site string, page_url string, visit_ord bigint, status int, content_type string, headers map<string,string>, html string"))

    delta = extract.hydration_delta(raw('<meta name="a" content="1">'), raw('<meta name="a" content="2"><link rel="icon" href="/i">'))
    assert sorted((r["side"], r["key"]) for r in delta.collect()) == [("rendered", "link:icon:https://a.example/i"), ("rendered", "meta:a:2"), ("static", "meta:a:1")]


def test_stream(spark, tmp_path):
    from loomaudit.streaming import lint

    row = [(A, f"{A}/x", 0, 200, "text/html", {}, "<title>x</title>")]
    spark.createDataFrame(row, lint.FETCHES).write.parquet(str(tmp_path / "in"))
    stream = lint.verdicts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.table("verdicts").count() == 25


def test_baseline_round_trip(spark, tmp_path):
    found = spark.createDataFrame([("1", "seo", "r", "warning", "p", "s")], snapshot.FINDINGS)
    report.write_json(found, str(tmp_path / "b"))
    assert snapshot.baseline(spark, str(tmp_path / "b")).collect() == found.collect()
