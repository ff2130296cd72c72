"""Parts that queries over tables do not meet at their edges."""

import gzip

import pytest
from pyspark.sql import functions as F

from loomaudit.operators import extract, links, locales, ranks
from loomaudit.plans import artefacts, cards, producer
from loomaudit.sources import sitemaps

# ---- places in large groups


def test_places_of_one_group_are_found_over_many_ranges(spark):
    """One group of all rows lies in several ranges, and each range holds a fair part of it."""
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalescing, "false")  # as on a table too large for one task
    rows = spark.range(40_000).select(F.lit("a").alias("g"), F.format_string("%08d", (F.col("id") * 7919) % 40_009).alias("u")).withColumn("h", F.lit(None).cast("string"))
    got = ranks.placed(rows, ["g", "h"], ["u"])
    assert got.columns == ["g", "u", "h", "size", "place"]
    plain = sorted(r["u"] for r in rows.collect())
    out = {r["u"]: (r["place"], r["size"]) for r in got.collect()}
    assert all(out[u] == (i, 40_000) for i, u in enumerate(plain))
    parts = rows.repartitionByRange("g", "h", "u").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset(coalescing)
    assert len(parts) > 4 and max(r["count"] for r in parts) < 2.5 * 40_000 / len(parts)


def test_places_of_many_groups_and_ties(spark):
    rows = spark.createDataFrame([(None, "b"), (None, "a"), ("x", "a"), ("x", "a"), ("", "q")], "g string, u string")
    got = sorted((r["g"] or "-", r["u"], r["place"], r["size"]) for r in ranks.placed(rows, ["g"], ["u"]).collect())
    assert got == [("-", "a", 0, 2), ("-", "b", 1, 2), ("-", "q", 0, 1), ("x", "a", 0, 2), ("x", "a", 1, 2)]
    assert ranks.placed(rows.limit(0), ["g"], ["u"]).count() == 0


# ---- sitemaps


def urlset(n):
    return b"<urlset>" + b"".join(b"<url><loc>https://a.b/%d</loc></url>" % i for i in range(n)) + b"</urlset>"


def test_documents_are_read_within_bounds(monkeypatch):
    whole = urlset(2000)
    assert [len(sitemaps.read_document(x)["entries"]) for x in (whole, gzip.compress(whole), gzip.compress(whole[:30_000]) + gzip.compress(whole[30_000:]))] == [2000] * 3
    monkeypatch.setattr(sitemaps, "MOST_BYTES", 20_000)
    for body in (whole, gzip.compress(whole)):
        found = sitemaps.read_document(body)
        assert found["kind"] == "urlset" and found["bytes"] > 20_000 and 0 < len(found["entries"]) < 2000
    bomb = gzip.compress(b"<urlset>" + b" " * 50_000_000)
    assert len(bomb) < 100_000 and sitemaps.read_document(bomb)["bytes"] == 20_001
    assert sitemaps.read_document(gzip.compress(whole)[:500])["kind"] == "unknown"


@pytest.mark.parametrize(("body", "kind", "n"), [(None, "unknown", 0), (b"", "unknown", 0), (b"<html/>", "unknown", 0), (b"<urlset><url>", "unknown", 0), (b"\x1f\x8bno", "unknown", 0), (b"<urlset></urlset>", "urlset", 0), (b"<S:urlset xmlns:S='x'><S:url><S:loc> u </S:loc></S:url><S:sitemap><S:loc>v</S:loc></S:sitemap></S:urlset>", "urlset", 1), (b"<sitemapindex><sitemap><loc>a</loc></sitemap><url><loc>b</loc></url></sitemapindex>", "index", 1)])
def test_documents(body, kind, n):
    found = sitemaps.read_document(body)
    assert (found["kind"], len(found["entries"])) == (kind, n)


# ---- structured data, palettes, files


def test_structured_data_that_is_empty(spark):
    row = [("https://a.b", "https://a.b/", 0, 200, "text/html", {}, "<script type='application/ld+json'> </script><script type='application/ld+json'>[]</script>")]
    pages = extract.declared(extract.raw_pages(spark.createDataFrame(row, "site string, page_url string, visit_ord bigint, status int, content_type string, headers map<string,string>, html string")))
    assert [(r["is_empty"], r["parse_error"]) for r in extract.json_ld(pages).orderBy("index").collect()] == [(True, True), (False, False)]


CSS = """@custom-variant dark (&:is(.dark *)); /* :root { --a: oklch(10% 0 0); } */
:root { @layer x { --a: oklch(100% 0 0); } --b: oklch(50% 50% 180 / 40%); --c: oklch(from red l c h); --d: oklch(50% 0 20%); --a: oklch(0% 0 0); }
.dark .grain { --a: oklch(20% 0 0) } .dark   { --a: oklch(0 0 0); @media x { --e: oklch(100% 0 0) } } .late { --z: oklch(1 0 0) """


@pytest.mark.parametrize(("scope", "found"), [(None, {"a": "#ffffff", "b": "#008368", "e": "#ffffff", "z": "#ffffff"}), (":root", {"a": "#ffffff", "b": "#008368"}), (".dark", {"a": "#000000", "e": "#ffffff"}), (".late", {"z": "#ffffff"}), (".none", {})])
def test_palette_scopes(spark, scope, found):
    assert {r["name"]: r["hex"] for r in cards.palette(spark.createDataFrame([(CSS,), (None,)], "text string"), scope).collect()} == found


def test_files_are_written_once(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rendered = []

    def render(due):
        rendered.append(sorted(r["path"] for r in due.select("path").collect()))
        return due.withColumn("body", F.concat(F.lit("card of "), "title").cast("binary"))

    def wanted(*rows):
        df = spark.createDataFrame(rows, "path string, title string")
        return df.withColumn("fingerprint", artefacts.fingerprint(F.col("title"), F.lit("v1")))

    def status(df):
        return {r["path"]: r["status"] for r in df.collect()}

    first = wanted(("a.txt", "A"), ("x/b.txt", "B"))
    assert status(artefacts.write(first, root, render, check=True)) == {"a.txt": "absent", "x/b.txt": "absent"} and not rendered
    assert status(artefacts.write(first, root, render)) == {"a.txt": "written", "x/b.txt": "written"}
    assert (tmp_path / "out/x/b.txt").read_text() == "card of B"
    assert status(artefacts.write(first, root, render)) == {"a.txt": "unchanged", "x/b.txt": "unchanged"} and len(rendered) == 1
    second = wanted(("a.txt", "A"), ("x/b.txt", "other"))
    assert status(artefacts.write(second, root, render, check=True)) == {"a.txt": "unchanged", "x/b.txt": "stale"}
    assert status(artefacts.write(second, root, render)) == {"a.txt": "unchanged", "x/b.txt": "written"} and rendered[-1] == ["x/b.txt"]
    (tmp_path / "out/a.txt").unlink()
    assert status(artefacts.write(second, root, render)) == {"a.txt": "written", "x/b.txt": "unchanged"}
    with pytest.raises(ValueError):
        artefacts.write(first.limit(0), root, render)
    with pytest.raises(ValueError):
        artefacts.write(first.union(first), root, render)


def test_a_run_that_fails_commits_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    made = spark.createDataFrame([("a.txt", "A")], "path string, title string").withColumn("fingerprint", artefacts.fingerprint(F.col("title")))
    with pytest.raises(Exception):
        artefacts.write(made, root, lambda due: due.withColumn("body", F.raise_error(F.lit("no"))))
    assert artefacts._versions(root) == [] and [r["status"] for r in artefacts.write(made, root, lambda d: d.withColumn("body", F.lit(b"x"))).collect()] == ["written"]


def test_fingerprints_do_not_run_together(spark):
    row = spark.range(1).select(artefacts.fingerprint(F.lit("ab"), F.lit("c")).alias("a"), artefacts.fingerprint(F.lit("a"), F.lit("bc")).alias("b")).first()
    assert row["a"] != row["b"]


# ---- rows that no other test names


def test_link_reasons_and_tokens(spark):
    told = spark.createDataFrame([(404, False, False), (0, False, False), (200, True, False), (200, False, True), (200, False, False)], "status int, looped boolean, soft boolean")
    assert [r[0] for r in told.select(links.reason_of(F.col("status"), F.col("looped"), F.col("soft"))).collect()] == ["HTTP 404", "no answer", "redirect loop", "soft-404", None]
    row = [("https://a.b", "https://a.b/", 0, 200, "text/html", {}, "<a href=x rel=' NoFollow  UGC '>x</a><a href=y>y</a>")]
    pages = extract.declared(extract.raw_pages(spark.createDataFrame(row, "site string, page_url string, visit_ord bigint, status int, content_type string, headers map<string,string>, html string")))
    assert [r["rel"] for r in links.occurrences(pages).orderBy("ord").collect()] == [["nofollow", "ugc"], []]


def test_steps_of_type_must_ascend(spark):
    with pytest.raises(ValueError):
        cards.fitted_size(F.lit(1), [(20, 72), (20, 56)], 36)


def test_robots_of_a_site():
    assert producer.robots_body("https://a.example/", True) == "User-agent: *\nAllow: /\nSitemap: https://a.example/sitemap.xml\n"
    assert producer.robots_body("https://a.example", False) == "User-agent: *\nDisallow: /\n"


def test_holes_need_no_grid(spark):
    cells = spark.createDataFrame([("s", f"/{i}", x, "u") for i in range(50) for x in ("en", "fr", "de") if not (i % 5 == 0 and x == "de")], "site string, route string, locale string, url string")
    cells = cells.withColumns({"inspected": F.lit(True), "source": F.lit("crawled")})
    a, b = (sorted(tuple(r) for r in locales.holes(x).collect()) for x in (cells, locales.gridded(cells)))
    assert a == b and len(a) == 10 and {r[4] for r in a} == {"de"}
    assert locales.gridded(cells).count() == 150
