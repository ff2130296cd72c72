"""Audits of live sites: what a snapshot needs is fetched by Spark tasks, then audited as any snapshot.

Robots files, icons and sitemaps are asked for first; what the sitemaps list, or
a few pages of each family of it, are seeds of a crawl beside each site's entry.
A site without a sitemap is crawled from its entry alone. Links that the crawl
did not answer, the first bytes of images and icons, manifests, and a budget of
sitemap entries are then probed. Every round is stored, so nothing is asked for
twice.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomaudit.functions import urls as U
from loomaudit.operators import coverage, crawl, extract, links, robots
from loomaudit.operators.graph import cut, stored
from loomaudit.plans import audit
from loomaudit.sources import fetching, sitemaps, snapshot, web

#: Links of a site that are probed; entries of a sitemap likewise; room that a selection leaves for the entry and what it leads to.
MOST_LINKS, MOST_PROBES, HEADROOM = 10_000, 200, 5


def _asked(urls: DataFrame, ask: fetching.Ask) -> DataFrame:
    """urls (site, requested_url) with the fields of their answers beside them, stored."""
    got = stored(ask(urls), "live-answers")
    return got.select("site", "requested_url", *(F.col(f"answer.{c}").alias(c) for c in ("page_url", "status", "content_type", "redirect_count", "html", "head", "reason")))


def _beside(sites: DataFrame, *paths: str) -> DataFrame:
    return sites.select("site", F.explode(F.array(*(F.concat("site", F.lit(p)) for p in paths))).alias("requested_url"))


def _documents(answers: DataFrame) -> DataFrame:
    """Answers as `sitemaps.discover` reads them."""
    return answers.select("site", F.col("requested_url").alias("url"), "status", F.lit(None).cast("string").alias("location"), F.col("html").cast("binary").alias("body"))


def snapshot_of(entries: DataFrame, options: audit.Options | None = None, timeout: float = web.TIMEOUT_S, pace_s: float = 0.0) -> tuple[audit.Snapshot, dict[str, DataFrame]]:
    """What an audit of entries (url) needs, and the crawl's own tables (see `crawl.live`), with `sitemap_entries`."""
    o = options or audit.Options()
    page, probe, icon, part = (fetching.asking(p, timeout, pace_s) for p in web.PROBES)
    starts = cut(entries.select(U.canonical_url(U.parsed(U.entry_url(F.col("url")))).alias("url")).where("url is not null").select(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0).alias("site"), "url").distinct())
    sites = starts.select("site").distinct()
    robots_files = web.robots_files(_asked(_beside(sites, "/robots.txt"), page))
    favicons = web.favicons(_asked(_beside(sites, "/favicon.ico"), icon))
    seeds = starts.withColumn("ord", F.lit(-1))
    most, responses, listed = o.max_pages, None, None
    if o.use_sitemap:
        said = robots.lines(robots_files.select("site", "body")).where("kind = 'sitemap'").select("site", F.col("value").alias("url"), "line")
        named = said.select("site", F.col("url").alias("requested_url")).unionByName(_beside(sites, "/sitemap.xml", "/sitemap_index.xml")).distinct()
        first = _documents(_asked(named, page))
        children = sitemaps.children(first)
        responses = first.unionByName(_documents(_asked(children.select("site", F.col("url").alias("requested_url")).join(named, ["site", "requested_url"], "left_anti"), page)))
        _, listed, _ = sitemaps.discover(sites, said, responses.select("site", "url", "status", "body"))
        listed = cut(listed)
        chosen = listed.select("site", F.col("loc").alias("url"), "ord")
        if o.coverage == "structural":
            kept = coverage.selected(coverage.patterned(chosen.select("site", "url", U.parsed(F.col("url"))["path"].alias("path")), o.locales)).where("keep").select("site", "url")
            chosen = cut(chosen.join(kept, ["site", "url"], "left_semi"))
            largest = chosen.groupBy("site").count().agg(F.max("count")).first()[0] or 0
            most = max(most, largest + HEADROOM)
        on_site = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0) == F.col("site")
        seeds = seeds.unionByName(chosen.where(on_site))
    found = crawl.live(seeds, page, o.depth if o.depth is not None else 2, most, o.include, o.exclude)
    fetches = stored(found["fetches"], "live-fetches")
    raw = extract.raw_pages(fetches.where(snapshot.is_healthy(F.col("status")) & snapshot.is_html(F.col("content_type"))))
    declared = stored(extract.declared(raw).select("site", "page_url", "anchors", "og_images", "icons", "manifest_href"), "live-declared")
    targets = links.targets(links.occurrences(declared.select("site", "page_url", "anchors")))
    if not o.check_external:
        targets = targets.where("kind = 'internal'")
    unknown = targets.where(F.col("url").rlike("(?i)^https?://")).join(fetches.select(F.col("page_url").alias("url")), "url", "left_anti")
    of_site = unknown.withColumn("site", F.regexp_extract("first_page", "^[a-z]+://[^/?#]*", 0))
    probed = _asked(links.within(of_site, MOST_LINKS).select("site", F.col("url").alias("requested_url")), probe)
    # An answer at the end of redirects is told as its first step, which is all that a verdict needs to know of them.
    moved = (F.col("redirect_count") > 0) & (F.col("status") > 0)
    told = probed.select("site", F.col("requested_url").alias("url"), F.when(moved, 302).otherwise(F.col("status")).alias("status"), F.when(moved, F.col("page_url")).alias("location"), F.col("html").cast("binary").alias("body"))
    ended = probed.where(moved).select("site", F.col("page_url").alias("url"), "status", F.lit(None).cast("string").alias("location"), F.col("html").cast("binary").alias("body"))
    answers = told.unionByName(ended)
    if responses is not None:
        answers = responses.unionByName(answers)
    images = _asked(snapshot.wanted_assets(declared, o.check_external).select("site", F.col("url").alias("requested_url")), part)
    assets = images.select(F.col("requested_url").alias("url"), "status", "content_type", "head").dropDuplicates(["url"])
    manifests = _asked(declared.where("manifest_href is not null").select("site", F.col("manifest_href").alias("requested_url")).distinct(), page)
    read = manifests.select(F.col("requested_url").alias("href"), "status", F.when(snapshot.is_healthy(F.col("status")), F.col("html")).alias("body"))
    snap = audit.Snapshot(fetches, robots=robots_files, assets=assets, manifests=read, responses=stored(answers.dropDuplicates(["url"]), "live-responses"), favicons=favicons)
    return snap, found | ({"sitemap_entries": listed} if listed is not None else {})


def run_live_audit(entries: DataFrame, options: audit.Options | None = None, timeout: float = web.TIMEOUT_S, pace_s: float = 0.0) -> dict[str, DataFrame]:
    """The tables of `audit.run_audit` for live entries (url), with those of the crawl."""
    o = options or audit.Options()
    snap, found = snapshot_of(entries, o, timeout, pace_s)
    # What was fetched is what is judged: the crawl has already kept to depth, pages and families.
    out = audit.run_audit(snap, replace(o, depth=None, coverage="all"), ask=fetching.asking("link", timeout, pace_s), most_probes=MOST_PROBES)
    return out | {f"crawl_{k}": v for k, v in found.items() if k not in ("fetches", "sitemap_entries")}
