"""A whole audit of snapshot tables: extraction, rules, links, translations, report.

Each step that several others read is checkpointed in the shared folder, so
that no plan holds all of the audit and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomaudit.functions import urls as U
from loomaudit.operators import clusters, coverage, crawl, extract, links, locales, robots
from loomaudit.operators.graph import cut
from loomaudit.plans import page_rules, report, site_rules
from loomaudit.sources import sitemaps, snapshot


@dataclass(frozen=True)
class Snapshot:
    """What was fetched; all tables may hold many sites (a site is an origin). Those that are None were not looked for.

    fetches: (site, page_url, visit_ord, status, content_type, headers, html); robots: (site, url, status, final_url, body); responses: (site, url, status, location, final_url, body as bytes) of sitemaps and link targets; assets: (url, status, content_type, head); manifests: (href, status, body); favicons: (site, found)."""

    fetches: DataFrame
    robots: DataFrame | None = None
    responses: DataFrame | None = None
    assets: DataFrame | None = None
    manifests: DataFrame | None = None
    favicons: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    """depth and max_pages bound a crawl from entries; None judges every fetched page. coverage: all, or structural to judge a few pages of each family."""

    locales: list[str] = field(default_factory=list)
    ignore_holes: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    profile: str = "default"
    coverage: str = "all"
    check_external: bool = True
    depth: int | None = None
    max_pages: int = 200
    use_sitemap: bool = True
    now: str = "2026-01-01"
    max_debt: int | None = None
    fail_on: str = "warning"


def run_audit(snap: Snapshot, options: Options | None = None, entries: DataFrame | None = None, ask: Callable[[DataFrame], DataFrame] | None = None, most_probes: int = 0) -> dict[str, DataFrame]:
    """With `ask` (see `sources.fetching`), up to most_probes entries of each sitemap that nothing has answered yet are asked for.

    The tables of a report: findings, summary, conformance, advisories, links, matrix, holes, reciprocity, families, and the sitemap's where there are responses."""
    o = options or Options()
    rules = page_rules.under_profile(page_rules.page_rules(), o.profile)
    spark = snap.fetches.sparkSession
    fetched = snapshot.first_answers(snap.fetches)
    raw = cut(extract.raw_pages(fetched.where(snapshot.is_healthy(F.col("status")) & snapshot.is_html(F.col("content_type")))))
    out: dict[str, DataFrame] = {}
    if o.depth is not None and entries is not None:
        answers = fetched.select(U.canonical_url(U.parsed(F.col("page_url"))).alias("url"), "status", F.col("page_url").alias("final_url"))
        visited, errors = crawl.crawl(entries, raw, answers, o.depth, o.max_pages, o.include, o.exclude)
        raw = raw.withColumn("final_url", U.canonical_url(U.parsed(F.col("page_url")))).join(visited.select("site", "final_url"), ["site", "final_url"], "left_semi").drop("final_url")
        out |= {"visited": visited, "crawl_errors": errors}
    pages = extract.declared(raw)
    pages = pages.withColumns({"path": F.regexp_extract("page_url", "^[a-z]+://[^/?#]*([^?#]*)", 1), "path_query": F.regexp_extract("page_url", "^[a-z]+://[^/?#]*([^#]*)", 1)})
    pages = cut(report.without_canonical_duplicates(pages))
    if snap.assets is not None:
        none = spark.createDataFrame([], "href string, status int, body string")
        pages = snapshot.with_probes(pages, snapshot.asset_probes(snap.assets), snap.manifests if snap.manifests is not None else none)
    else:
        pages = snapshot.without_probes(pages)
    if o.coverage == "structural":
        chosen = coverage.selected(coverage.patterned(pages.select("site", F.col("page_url").alias("url"), "path"), o.locales))
        out["families"] = coverage.families(chosen)
        pages = pages.join(chosen.where("keep").select("site", F.col("url").alias("page_url")), ["site", "page_url"], "left_semi")
    said = robots.lines(snap.robots.select("site", "body")) if snap.robots is not None else None
    documents = listed = diagnostics = None
    if o.use_sitemap and snap.responses is not None:
        declared = said.where("kind = 'sitemap'").select("site", F.col("value").alias("url"), "line") if said is not None else spark.createDataFrame([], "site string, url string, line int")
        documents, listed, diagnostics = map(cut, sitemaps.discover(fetched.select("site").distinct(), declared, snap.responses.select("site", "url", "status", "body")))
        out |= {"sitemap_documents": documents, "sitemap_entries": listed, "sitemaps": diagnostics}
    heads, _ = clusters.from_heads(pages)
    index = cut(clusters.combine(clusters.from_sitemap(listed)[0], heads)[0] if listed is not None else heads)
    urls_of = listed.select("site", F.col("loc").alias("url"), U.parsed(F.col("loc"))["path"].alias("path")) if listed is not None else pages.select("site", F.lit("").alias("url"), F.lit("").alias("path")).where("false")
    axis = locales.axis(urls_of.select("site", "path").unionByName(pages.select("site", F.lit("").alias("path"))), o.locales)
    occurrences = cut(links.occurrences(pages))
    checked_urls = occurrences if o.check_external else occurrences.where("kind = 'internal'")
    answers = (snap.responses if snap.responses is not None else fetched.select(F.col("page_url").alias("url"), "status", F.lit(None).cast("string").alias("location"), F.lit("").alias("body"))).select("url", "status", "location", F.col("body").cast("string").alias("body"))
    known = fetched.select(F.col("page_url").alias("url"), "status", F.lit(None).cast("string").alias("location"), F.lit("").alias("body"))
    checked = cut(links.checks(checked_urls.join(answers.unionByName(known).select("url").distinct(), "url", "left_semi"), answers.unionByName(known).dropDuplicates(["url"])))
    probes = None
    if listed is not None:
        if ask is not None and most_probes > 0:
            probes, unprobed = links.probed_entries(listed, fetched, checked, ask, most_probes)
            probes = cut(probes)
        else:
            probes, unprobed = links.entry_probes(listed, fetched, checked)
        out |= {"unprobed": unprobed, "entry_probes": probes, "uncrawled": links.uncrawled(listed, pages)}
    site = site_rules.Site(
        pages, F.lit(o.now).cast("timestamp"), said=said, sitemaps=diagnostics, documents=documents, entries=listed, axis=axis, clusters=index, favicons=snap.favicons, probes=probes,
        robots=None if snap.robots is None else snap.robots.select("site", "url", "status", "final_url", F.octet_length(F.coalesce("body", F.lit(""))).alias("bytes")),
    )
    verdicts = cut(page_rules.evaluate(pages, rules))
    broken = links.broken_by_page(occurrences, checked)
    cells = cut(locales.filled(pages, urls_of, index.select("key", "route")))
    matrix = locales.gridded(cells)
    multilingual = axis.where("locale <> 'x-default'").groupBy("site").agg(F.count_distinct("locale").alias("n")).where("n >= 2").select("site")
    holes = locales.holes(cells, o.ignore_holes).join(multilingual, "site", "left_semi")
    back = locales.reciprocity(pages)
    origin = F.regexp_extract("page_url", "^[a-z]+://[^/?#]*", 0)
    findings = cut(report.all_findings(
        report.page_findings(verdicts), report.site_findings(site_rules.evaluate(site)), report.link_findings(broken), report.unreachable_findings(fetched), report.translation_findings(holes, back)
    ).withColumn("site", origin))
    summary = report.summary(fetched.select("site"), pages, findings)
    fatal = F.lit(False)
    if diagnostics is not None:
        summary = summary.join(report.fatal_sites(diagnostics), "site", "left")
        fatal = F.col("reason").isNotNull()
    debt = F.lit(False) if o.max_debt is None else F.col("findings") > o.max_debt
    out |= {
        "pages": pages, "findings": findings, "conformance": report.conformance(verdicts), "advisories": page_rules.advisories(pages), "links": links.ordered(links.rows(checked, occurrences)), "severities": report.severity_counts(findings), "matrix": matrix, "holes": holes, "reciprocity": back,
        "summary": summary.withColumn("exit_code", F.when(debt & ~fatal, 1).otherwise(report.exit_code(F.col("verdict"), o.fail_on, fatal))),
    }
    return out
