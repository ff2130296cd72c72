"""Locales of a site: its axis, the grid of translations, holes and missing back links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U
from loomaudit.functions.subtags import is_known_language, is_valid
from loomaudit.operators.clusters import shared
from loomaudit.operators.graph import stored

def axis(urls: DataFrame, explicit: list[str] | None = None) -> DataFrame:
    """(site, locale, source) that a site serves: those named, with the locale prefixes of its listed urls (site, path)."""
    listed = urls.select("site", U.locale_prefix(F.col("path")).alias("locale")).where("locale is not null").distinct().withColumn("source", F.lit("sitemap"))
    if not explicit:
        return listed
    named = urls.select("site").distinct().select("site", F.explode(F.lit([x.lower() for x in explicit if x.lower() != "x-default"])).alias("locale"), F.lit("explicit").alias("source"))
    return named.unionByName(listed).groupBy("site", "locale").agg(F.min("source").alias("source"))


def candidates(pages: DataFrame) -> DataFrame:
    """(site, tag, pages, known_language, lang_agrees, langs: joined) for the locale-shaped prefixes of pages (site, path, html_lang)."""
    tagged = pages.select("site", U.locale_prefix(F.col("path")).alias("tag"), F.nullif(F.lower(X.trimmed(F.col("html_lang"))), F.lit("")).alias("lang")).where("tag is not null")
    seen = tagged.groupBy("site", "tag").agg(F.count("*").alias("pages"), F.sort_array(F.collect_set("lang")).alias("langs"))
    primary = F.split_part("tag", F.lit("-"), F.lit(1))
    agrees = F.when(F.size("langs") > 0, F.exists("langs", lambda x: F.split_part(x, F.lit("-"), F.lit(1)) == primary))
    return seen.select("site", "tag", "pages", is_known_language(primary).alias("known_language"), agrees.alias("lang_agrees"), F.array_join("langs", ",").alias("langs"))


def alternates(pages: DataFrame) -> DataFrame:
    """(site, page_url, visit_ord, ord, tag: as written, locale, href: normalised or null) for each alternate of declared pages."""
    each = pages.select("site", "page_url", "visit_ord", F.posexplode("alternates").alias("ord", "a"))
    parsed = each.withColumn("u", U.parsed(F.col("a.href")))
    locale = F.when(F.col("a.is_default"), "x-default").otherwise(F.lower(X.trimmed(F.col("a.hreflang"))))
    return parsed.select("site", "page_url", "visit_ord", "ord", F.col("a.hreflang").alias("tag"), locale.alias("locale"), F.col("u.href").alias("href"), F.col("u.path").alias("path"), U.same_page_key(F.col("u")).alias("key"))


#: Parts that the routes of a site are dealt to where its list of locales meets them.
PARTS = 64


def filled(pages: DataFrame, listed: DataFrame, clusters: DataFrame) -> DataFrame:
    """(site, route, locale, url, inspected, source): the cells of the grid that something fills.

    Writers in order, the first keeping a cell: each page (site, page_url, visit_ord, path, alternates), then its alternates; then listed urls (site, url, path). clusters (key, route) move a URL to the row that its cluster names."""
    own_route = U.split_route(F.col("path"))
    key = U.same_page_key(U.parsed(F.col("url")))
    selves = pages.select("site", F.col("page_url").alias("url"), own_route.alias("at"), F.struct(F.lit(0).alias("kind"), F.col("visit_ord").cast("bigint").alias("visit"), F.lit(-1).alias("ord"), F.lit("").alias("url")).alias("writer")).select("site", "url", F.col("at.route").alias("route"), F.col("at.locale").alias("locale"), "writer")
    links = alternates(pages).where("href is not null").select("site", F.col("href").alias("url"), U.split_route(F.col("path"))["route"].alias("route"), "locale", F.struct(F.lit(0).alias("kind"), F.col("visit_ord").cast("bigint").alias("visit"), F.col("ord"), F.lit("").alias("url")).alias("writer"))
    others = listed.select("site", "url", own_route.alias("at"), F.struct(F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("visit"), F.lit(0).alias("ord"), F.col("url").alias("url")).alias("writer")).select("site", "url", F.col("at.route").alias("route"), F.col("at.locale").alias("locale"), "writer")
    written = selves.unionByName(links).unionByName(others).withColumn("key", key).join(clusters.select("key", F.col("route").alias("named")), "key", "left").withColumn("route", F.coalesce("named", "route"))
    kept = written.groupBy("site", "route", "locale").agg(F.min_by("url", "writer").alias("url"))
    crawled, known = pages.select("site", F.col("page_url").alias("url"), F.lit(True).alias("crawled")).distinct(), listed.select("site", "url", F.lit(True).alias("known")).distinct()
    sourced = kept.join(crawled, ["site", "url"], "left").join(known, ["site", "url"], "left")
    source = F.when(F.col("crawled"), "crawled").when(F.col("known"), "sitemap").otherwise("alternate")
    return sourced.select("site", "route", "locale", "url", F.coalesce("crawled", F.lit(False)).alias("inspected"), source.alias("source"))


def _beside_locales(routes: DataFrame, cells: DataFrame) -> DataFrame:
    """routes (site, route, ...) with the sorted locales of their site. The routes of one site, however many, are dealt to PARTS tasks; the lists, of a row for each site, are repeated for each."""
    lists = cells.groupBy("site").agg(F.sort_array(F.collect_set("locale")).alias("locales"))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    return routes.withColumn("part", F.pmod(F.xxhash64("route"), F.lit(PARTS))).join(lists, ["site", "part"]).drop("part")


def gridded(cells: DataFrame) -> DataFrame:
    """Filled cells with those between them: every route in every locale of a site; url is null where nothing fills a cell. As large as the grid, which is for readers; `holes` does without it."""
    grid = _beside_locales(cells.select("site", "route").distinct(), cells).select("site", "route", F.explode("locales").alias("locale"))
    return grid.join(cells, ["site", "route", "locale"], "left").select("site", "route", "locale", "url", F.coalesce("inspected", F.lit(False)).alias("inspected"), "source")


def matrix(pages: DataFrame, listed: DataFrame, clusters: DataFrame) -> DataFrame:
    """(site, route, locale, url, inspected, source): the grid of `filled`."""
    return gridded(filled(pages, listed, clusters))


def holes(cells: DataFrame, ignored_routes: list[str] | None = None) -> DataFrame:
    """(id, site, route, present, missing: joined locales) of routes that only some locales of a site serve, from cells, filled or gridded. A route is one set of locales against its site's; the grid is not needed."""
    real = cells.where("locale <> 'x-default'")
    present = real.where(F.col("url").isNotNull())
    if ignored_routes:
        present = present.where(~X.matches_any(F.col("route"), ignored_routes))
    by_route = present.groupBy("site", "route").agg(F.sort_array(F.collect_set("locale")).alias("present"))
    some = _beside_locales(by_route, real).withColumn("missing", F.array_except("locales", "present")).where(F.size("missing") > 0)
    return some.select(X.identity("i18n", F.lit("hole"), F.col("route")).alias("id"), "site", "route", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


def hidden_holes(cells: DataFrame, ignored_routes: list[str]) -> DataFrame:
    """(site, hidden): how many holes the ignored routes keep out of a report."""
    return holes(cells).where(X.matches_any(F.col("route"), ignored_routes)).groupBy("site").agg(F.count("*").alias("hidden"))


#: Rows of a group that meet another group's as one array.
CHUNK = 500


def _chunked(rows: DataFrame, group: list[str], by: str, into: str) -> DataFrame:
    """rows dealt into arrays of about CHUNK: (group, `<into>_part`, into: array of the other columns)."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = rows.join(sizes, group).withColumn(f"{into}_part", F.pmod(F.xxhash64(by), F.col("parts")))
    return dealt.groupBy(*group, f"{into}_part").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in group))).alias(into))


def _without_link_back(carried: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(site, url, locale, peer_url, url_key, peer_key): what pages (site, page_url, list) name by their edges (list, locale, href) that are pages and do not name them by their links (list, href).

    Whether a page is named depends only on which lists the other one carries, so pages are judged against such sets of lists. Only what is missing is paired off, in arrays that are dealt over PARTS tasks: it may be as large as the square of a list."""
    # A link of a page to itself is its own link back; without it, a list that only one page carries and that names only this page says nothing.
    alone = carried.where("list is not null").groupBy("list").agg(F.min("page_url").alias("href"), F.max("page_url").alias("last")).where("href = last").select("list", "href")
    edges, links = (x.join(alone, ["list", "href"], "left_anti") for x in (edges, links))
    links = stored(links, "links")
    sets = carried.join(links.select("list").distinct(), "list", "left_semi").groupBy("page_url").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    named = carried.groupBy("page_url").agg(F.count_distinct("list").alias("n")).join(sets, "page_url", "left")
    key = U.route_key(U.parsed(F.col("page_url")), F.col("page_url"))
    pages = stored(named.select("page_url", (F.col("n") > 1).alias("many"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.sha2(F.coalesce(F.array_join("lists", "\0"), F.lit("")), 256).alias("set"), key.alias("key")), "linked-pages")
    often = edges.groupBy("locale", "href").agg((F.count_distinct("list") > 1).alias("often"))
    peers = edges.join(pages.select(F.col("page_url").alias("href"), "set", F.col("key").alias("peer_key")), "href").join(often, ["locale", "href"])
    peers = stored(peers.select("list", "set", "often", "locale", F.col("href").alias("peer_url"), "peer_key"), "peers")
    heard = pages.select("set", F.explode("lists").alias("list")).distinct().join(links, "list").select("set", F.col("href").alias("page_url")).distinct()
    unheard = carried.join(peers.select("list", "set").distinct(), "list").join(heard, ["set", "page_url"], "left_anti")
    senders = stored(unheard.join(pages.select("page_url", "many", F.col("key").alias("url_key")), "page_url").select("list", "set", "many", "site", F.col("page_url").alias("url"), "url_key"), "senders")
    met = _chunked(senders, ["list", "set", "many"], "url", "senders").join(_chunked(peers, ["list", "set", "often"], "peer_url", "peers"), ["list", "set"])
    met = met.repartition(PARTS, "list", "set", "senders_part", "peers_part")
    pairs = lambda df: df.select(F.explode("senders").alias("s"), "peers").select("s.site", "s.url", "s.url_key", F.explode("peers").alias("p")).select("site", "url", "p.locale", "p.peer_url", "url_key", "p.peer_key")
    # Only pages of several lists can name the same peer twice.
    return pairs(met.where("not (many and often)")).unionByName(pairs(met.where("many and often")).distinct())


def reciprocity(pages: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(id, code, site, url, locale, peer_url) for declared pages (site, page_url, alternates), or pages (site, page_url, list), a row for each list of alternates that a page carries, null for none, and lists (list, hreflang, href, is_default): invalid locales, alternates whose page does not link back, and pages of several locales without a default."""
    if lists is None:
        pages, lists = shared(pages.select("site", "page_url", "alternates"))
    carried = stored(pages.select("site", "page_url", "list").distinct(), "carried-lists")
    locale = F.when(F.col("is_default"), "x-default").otherwise(F.lower(X.trimmed(F.col("hreflang"))))
    read = lists.select("list", F.col("hreflang").alias("tag"), locale.alias("locale"), U.parsed(F.col("href"))["href"].alias("href")).distinct()
    alts = stored(read.withColumn("valid", is_valid(F.col("locale"))), "read-lists")
    none = F.lit(None).cast("string")
    url_key = U.route_key(U.parsed(F.col("url")), F.col("url"))
    invalid = carried.join(alts.where("not valid").select("list", "tag").distinct(), "list").select("site", F.col("page_url").alias("url"), F.col("tag").alias("locale")).distinct().select(F.lit("locale.invalid").alias("code"), "site", "url", "locale", none.alias("peer_url"), url_key.alias("url_key"), none.alias("peer_key"))
    edges = alts.where("valid and href is not null").select("list", "locale", "href").distinct()
    missing = _without_link_back(carried, edges, alts.where("href is not null").select("list", "href").distinct()).select(F.lit("missing-back-link").alias("code"), "site", "url", "locale", "peer_url", "url_key", "peer_key")
    counts = carried.join(alts.select("list", "locale").distinct(), "list").groupBy("site", "page_url").agg(F.count_distinct(F.when(F.col("locale") != "x-default", F.col("locale"))).alias("n"), F.bool_or(F.col("locale") == "x-default").alias("has_default"))
    absent = counts.where("n >= 2 and not has_default").select("site", F.col("page_url").alias("url")).select(F.lit("x-default-missing").alias("code"), "site", "url", none.alias("locale"), none.alias("peer_url"), url_key.alias("url_key"), none.alias("peer_key"))
    found = invalid.unionByName(missing).unionByName(absent)
    return found.select(X.identity("i18n", F.col("code"), F.col("url_key"), F.col("peer_key"), F.col("locale")).alias("id"), "code", "site", "url", "locale", "peer_url")


def unverified(cells: DataFrame) -> DataFrame:
    """(site, cells) that only an alternate vouches for."""
    return cells.groupBy("site").agg(F.count_if(F.col("source") == "alternate").alias("cells"))


def lookup(requested: DataFrame, served: DataFrame) -> DataFrame:
    """(requested, served) by dropping subtags from the right until one is served; else the only variant of the language; else null."""
    parts = F.split(F.lower(F.trim("requested")), "-")
    tries = requested.select("requested", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))).alias("tag"))
    known = served.select(F.col("locale").alias("served"), F.lower(F.trim("locale")).alias("tag"))
    exact = tries.join(known, "tag").groupBy("requested").agg(F.max_by("served", F.length("tag")).alias("exact"))
    variants = known.groupBy(F.split_part("tag", F.lit("-"), F.lit(1)).alias("language")).agg(F.count("*").alias("n"), F.min("served").alias("only")).where("n = 1")
    asked = requested.select("requested", F.split_part(F.lower(F.trim("requested")), F.lit("-"), F.lit(1)).alias("language")).distinct()
    return asked.join(exact, "requested", "left").join(variants, "language", "left").select("requested", F.coalesce("exact", "only").alias("served"))


def suggested(found: DataFrame) -> DataFrame:
    """(site, locales: joined) to pass as explicit ones, from candidates: those that are known languages and whose pages do not say otherwise; two at least."""
    plausible = found.where(F.col("known_language") & F.coalesce("lang_agrees", F.lit(True)))
    return plausible.groupBy("site").agg(F.sort_array(F.collect_set("tag")).alias("tags")).where(F.size("tags") >= 2).select("site", F.array_join("tags", ",").alias("locales"))


def order(tag: Column) -> list[Column]:
    """Sort keys: x-default first, then alphabetical."""
    return [(tag != "x-default").asc(), F.collate(tag, "UNICODE").asc()]


def by_evidence(found: DataFrame) -> DataFrame:
    """Candidates (see `candidates`), those that pages confirm first, then known languages, then those of more pages."""
    return found.orderBy(F.coalesce(F.col("lang_agrees"), F.lit(False)).desc(), F.col("known_language").desc(), F.desc("pages"), "site", "tag")
