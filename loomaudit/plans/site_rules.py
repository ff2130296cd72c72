"""Site rules: joins and aggregates over the tables of a site.

Each rule takes `Site` and returns (site, page_url, observed); its id, severity
and rigor stand in RULES. Rules of one's own are added to the list that
`evaluate` gets. A rule whose tables are absent finds nothing.

Several rules together read URLs parsed and keyed once (`keyed`). Rules on one
sitemap entry are expressions over it, met in one pass; what they and the rules
that name a sample find is counted and sampled in one go for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U
from loomaudit.operators import locales as L
from loomaudit.operators import robots as R
from loomaudit.operators.graph import stored

# Fixed values.
ROBOTS_BYTES, SITEMAP_ENTRIES, SITEMAP_BYTES = 512_000, 50_000, 52_428_800
CHANGE_FREQUENCIES = ("always", "hourly", "daily", "weekly", "monthly", "yearly", "never")
W3C_DATETIME = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?)?)?$"


#: What rules read of a page.
PAGE_COLUMNS = ("site", "page_url", "path", "path_query", "visit_ord", "canonical", "alternates", "robots", "googlebot", "x_robots", "html_lang")


@dataclass(frozen=True)
class Site:
    """The tables that rules read; all have a column site, and one run may hold many sites.

    pages: as declared, with path; robots: (url, status, final_url, bytes); said: lines of robots files; sitemaps: diagnostics of discovery; documents, entries: of sitemaps; axis: (locale); clusters: (key, route); probes: (loc, status, final_url); favicons: (found); now: the time of the run."""

    pages: DataFrame
    now: Column
    robots: DataFrame | None = None
    said: DataFrame | None = None
    sitemaps: DataFrame | None = None
    documents: DataFrame | None = None
    entries: DataFrame | None = None
    axis: DataFrame | None = None
    clusters: DataFrame | None = None
    probes: DataFrame | None = None
    favicons: DataFrame | None = None


@dataclass(frozen=True)
class SiteRule:
    id: str
    severity: str
    rigor: str
    needs: tuple[str, ...]
    find: Callable[[Site], DataFrame]
    #: Instead of `find`, where several rules run: the values (site, page_url, v) that are sampled, or struct<page_url, v> of a parsed entry, null if it is sound.
    values: Callable[[Site], DataFrame] | None = None
    of_entry: Callable[[Site], Column] | None = None
    sources: tuple[str, ...] = ()


def _found(rows: DataFrame, observed: Column, page: Column | None = None) -> DataFrame:
    return rows.select("site", (F.col("site") if page is None else page).alias("page_url"), observed.cast("string").alias("observed"))


def _sampled(rows: DataFrame, column: str, *keys: str, most: int = 5) -> DataFrame:
    """(keys, sample): the first few values of each site, and how many there are. Values are counted and ranked in parts; no task holds those of a site."""
    keys = keys or ("site",)
    values = rows.select(*keys, F.col(column).alias("v")).where("v is not null").distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("v"))
    first = values.withColumn("n", place).where(F.col("n") <= most).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("v")), " ").alias("first"))
    counts = values.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(first, list(keys)).select(*keys, F.concat("first", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("sample"))


def _values(rows: DataFrame, column: str, page: Column | None = None) -> DataFrame:
    return rows.select("site", (F.col("site") if page is None else page).alias("page_url"), F.col(column).alias("v"))


def _sample_of(values: DataFrame) -> DataFrame:
    return _found(_sampled(values, "v", "site", "page_url"), F.col("sample"), F.col("page_url"))


def keyed(s: Site) -> Site:
    """The site with its entries and pages parsed and keyed once, as stored tables of what rules read."""
    out = s
    if s.entries is not None and "u" not in s.entries.columns:
        parsed = s.entries.withColumns({"u": U.parsed(F.col("loc")), "d": U.parsed(F.col("document_url"))} if "document_url" in s.entries.columns else {"u": U.parsed(F.col("loc"))})
        out = replace(out, entries=stored(parsed.withColumn("key", U.same_page_key(F.col("u"))), "site-entries"))
    if "key" not in s.pages.columns:
        read = [c for c in PAGE_COLUMNS if c in s.pages.columns]
        pages = s.pages.select(*read).withColumns({"u": U.parsed(F.col("page_url"))} | ({"canonical_key": U.same_page_key(U.parsed(F.col("canonical")))} if "canonical" in read else {}))
        out = replace(out, pages=stored(pages.withColumn("key", U.same_page_key(F.col("u"))), "site-pages"))
    return out


def _keyed_pages(s: Site) -> DataFrame:
    if "key" in s.pages.columns:
        return s.pages
    return s.pages.withColumns({"key": U.same_page_key(U.parsed(F.col("page_url"))), "canonical_key": U.same_page_key(U.parsed(F.col("canonical"))) if "canonical" in s.pages.columns else F.lit(None).cast("string")})


def _multilingual(s: Site) -> DataFrame:
    return s.axis.where("locale <> 'x-default'").groupBy("site").agg(F.count_distinct("locale").alias("n")).where("n >= 2").select("site")


def _root_allowed(s: Site) -> DataFrame:
    roots = s.robots.where(F.col("status").between(200, 299)).select("site", F.lit("/").alias("path"))
    return R.decisions(roots, s.said)


def _says(page_column: str, token: str) -> Column:
    return F.array_contains(X.comma_tokens(F.col(page_column)), token)


def says_noindex() -> Column:
    return _says("robots", "noindex") | _says("googlebot", "noindex") | _says("x_robots", "noindex")


def _route(s: Site, rows: DataFrame, url: str) -> DataFrame:
    """rows with the route of a URL: its cluster's, else its path's."""
    named = rows.withColumn("_u", F.col("u") if "u" in rows.columns else U.parsed(F.col(url))).withColumn("key", U.same_page_key(F.col("_u")))
    if s.clusters is not None:
        named = named.join(s.clusters.select("site", "key", F.col("route").alias("_named")), ["site", "key"], "left")
    else:
        named = named.withColumn("_named", F.lit(None).cast("string"))
    return named.withColumn("route", F.coalesce("_named", U.split_route(F.col("_u.path"))["route"])).drop("_u", "_named", "key")


def hreflang_missing(s: Site) -> DataFrame:
    return _found(s.pages.where(F.size("alternates") == 0).join(_multilingual(s), "site", "left_semi"), F.lit("no alternates"), F.col("page_url"))


def sitemap_locales(s: Site) -> DataFrame:
    """(site, route, locale) of the listed URLs, members of the axis only."""
    routed = _route(s, _with_parsed(s).select("site", "loc", "u"), "loc")
    tagged = routed.withColumn("locale", U.split_route(F.col("u.path"))["locale"])
    return tagged.join(s.axis.select("site", "locale").distinct(), ["site", "locale"], "left_semi").select("site", "route", "locale").distinct()


def _declared_locales(s: Site) -> DataFrame:
    heads = s.pages.where(F.size("alternates") > 0).withColumn("head", F.array_distinct(F.transform(F.filter("alternates", lambda a: ~a["is_default"]), lambda a: F.lower(F.trim(a["hreflang"])))))
    return _route(s, heads.select("site", "page_url", "head", *(["u"] if "u" in heads.columns else [])).where(F.size("head") > 0), "page_url")


def hreflang_cluster_incomplete(s: Site) -> DataFrame:
    listed = sitemap_locales(s).groupBy("site", "route").agg(F.sort_array(F.collect_set("locale")).alias("listed"))
    gaps = _declared_locales(s).join(_multilingual(s), "site", "left_semi").join(listed, ["site", "route"]).withColumn("gap", F.array_except("listed", "head"))
    return _found(gaps.where(F.size("gap") > 0), F.array_join("gap", ","), F.col("page_url"))


def hreflang_sitemap_mismatch(s: Site) -> DataFrame:
    listed = sitemap_locales(s).groupBy("site", "route").agg(F.sort_array(F.collect_set("locale")).alias("listed"))
    extra = _declared_locales(s).join(listed, ["site", "route"]).withColumn("extra", F.array_except("head", "listed"))
    return _found(extra.where(F.size("extra") > 0), F.array_join("extra", ","), F.col("page_url"))


def icons_ico_missing(s: Site) -> DataFrame:
    return _found(s.favicons.where("not found"), F.lit("/favicon.ico"))


def robots_blocks_site(s: Site) -> DataFrame:
    blocked = _root_allowed(s).where("not allowed")
    claims = s.pages.where(_says("robots", "index")).select("site").distinct().withColumn("claims", F.lit(True))
    return blocked.join(claims, "site", "left").select("site", F.col("site").alias("page_url"), F.col("rule").alias("observed"), F.when(F.col("claims"), "error").otherwise("warning").alias("severity"))


def robots_blocks_page(s: Site) -> DataFrame:
    open_sites = _root_allowed(s).where("allowed").select("site")
    asking = s.pages.where(_says("robots", "index")).join(open_sites, "site", "left_semi").select("site", "page_url", F.col("path_query").alias("path"))
    return _found(R.decisions(asking, s.said).where("not allowed"), F.concat_ws(":", "line", "rule"), F.col("page_url"))


def robotstxt_unreachable(s: Site) -> DataFrame:
    return _found(s.robots.where("status = 0 or status >= 500"), F.col("status"), F.col("url"))


def robotstxt_oversized(s: Site) -> DataFrame:
    return _found(s.robots.where(F.col("bytes") > ROBOTS_BYTES), F.col("bytes"), F.col("url"))


def robotstxt_cross_origin(s: Site) -> DataFrame:
    moved = s.robots.where(U.parsed(F.col("final_url"))["origin"] != U.parsed(F.col("url"))["origin"])
    return _found(moved, F.col("final_url"), F.col("url"))


def robotstxt_invalid_line(s: Site) -> DataFrame:
    bad = s.said.where("kind = 'invalid'").groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_set("line")), lambda n: n.cast("string")), ",").alias("at"))
    return _found(bad, F.col("at"))


def robotstxt_unknown_directive(s: Site) -> DataFrame:
    return _found(_sampled(s.said.where("kind = 'unknown'"), "name"), F.col("sample"))


def robotstxt_sitemap_relative(s: Site) -> DataFrame:
    odd = s.said.where("kind = 'sitemap'").where(~U.is_absolute_http(U.parsed(F.col("value"))))
    return _found(_sampled(odd, "value"), F.col("sample"))


def sitemap_missing(s: Site) -> DataFrame:
    return _found(s.sitemaps.where("not found and not unparsable"), F.lit("none"))


def sitemap_unparsable(s: Site) -> DataFrame:
    return _found(s.sitemaps.where("not found and unparsable"), F.lit("no candidate parses"))


def sitemap_empty(s: Site) -> DataFrame:
    return _found(s.sitemaps.where("found and urls = 0").join(s.pages.select("site").distinct(), "site", "left_semi"), F.lit("0"))


def sitemap_index_child_error(s: Site) -> DataFrame:
    return _found(s.sitemaps.where("child_errors > 0"), F.col("child_errors"))


def sitemap_limits_exceeded(s: Site) -> DataFrame:
    return _found(s.documents.where((F.col("entries") > SITEMAP_ENTRIES) | (F.col("bytes") > SITEMAP_BYTES)), F.concat_ws(" ", "entries", "bytes"), F.col("url"))


def _with_parsed(s: Site) -> DataFrame:
    return s.entries if "u" in s.entries.columns else s.entries.withColumn("u", U.parsed(F.col("loc")))


def _with_document(s: Site) -> DataFrame:
    entries = _with_parsed(s)
    return entries if "d" in entries.columns else entries.withColumn("d", U.parsed(F.col("document_url")))


def _odd(condition: Column, value: str = "loc", page: str = "site") -> Column:
    return F.when(condition, F.struct(F.col(page).alias("page_url"), F.col(value).alias("v")))


def _of_entries(s: Site, entries: DataFrame, check: Callable[[Site], Column]) -> DataFrame:
    return _sample_of(entries.withColumn("odd", check(s)).where("odd is not null").select("site", "odd.page_url", "odd.v"))


def invalid_url(s: Site) -> Column:
    return _odd(~U.is_absolute_http(F.col("u")))


def sitemap_entry_invalid_url(s: Site) -> DataFrame:
    return _of_entries(s, _with_parsed(s), invalid_url)


def out_of_scope(s: Site) -> Column:
    folder = F.regexp_replace("d.path", "[^/]*$", "")
    return _odd((F.col("u.origin") == F.col("d.origin")) & ~F.startswith("u.path", folder), page="document_url")


def sitemap_entry_out_of_scope(s: Site) -> DataFrame:
    return _of_entries(s, _with_document(s), out_of_scope)


def cross_host(s: Site) -> Column:
    return _odd(F.col("u.host") != F.col("d.host"))


def sitemap_entry_cross_host(s: Site) -> DataFrame:
    return _of_entries(s, _with_document(s), cross_host)


def sitemap_entry_protocol_mismatch(s: Site) -> DataFrame:
    schemes = _with_parsed(s).where("u is not null").groupBy("site").agg(F.sort_array(F.collect_set("u.scheme")).alias("schemes"))
    return _found(schemes.where(F.size("schemes") > 1), F.array_join("schemes", ","))


def invalid_lastmod(s: Site) -> Column:
    v = F.trim("lastmod")
    malformed = ~v.rlike(W3C_DATETIME)
    late = F.coalesce(F.try_to_timestamp(v) > s.now + F.expr("interval 1 day"), F.lit(False))
    return F.when((v != "") & (malformed | late), F.struct(F.col("site").alias("page_url"), v.alias("v")))


def sitemap_lastmod_invalid(s: Site) -> DataFrame:
    return _of_entries(s, s.entries, invalid_lastmod)


def invalid_field(s: Site) -> Column:
    frequency, priority = F.lower(F.trim(F.coalesce("changefreq", F.lit("")))), F.trim("priority")
    value = priority.try_cast("double")
    odd = ((frequency != "") & ~frequency.isin(*CHANGE_FREQUENCIES)) | (priority.isNotNull() & (priority != "") & (value.isNull() | (value < 0) | (value > 1)))
    return _odd(F.coalesce(odd, F.lit(False)))


def sitemap_field_invalid(s: Site) -> DataFrame:
    return _of_entries(s, s.entries, invalid_field)


def blocked_entries(s: Site) -> DataFrame:
    open_sites = _root_allowed(s).where("allowed").select("site")
    paths = _with_parsed(s).where("u is not null").join(open_sites, "site", "left_semi").select("site", "loc", F.concat("u.path", "u.query").alias("path"))
    return _values(R.decisions(paths, s.said).where("not allowed"), "loc")


def sitemap_entry_blocked_by_robots(s: Site) -> DataFrame:
    return _sample_of(blocked_entries(s))


def _listed_pages(s: Site) -> DataFrame:
    listed = _with_parsed(s).select("site", "loc", U.same_page_key(F.col("u")).alias("key")).where("key is not null")
    latest = _keyed_pages(s).groupBy("site", "key").agg(F.max_by(F.struct("canonical_key", says_noindex().alias("noindex")), "visit_ord").alias("p"))
    return listed.join(latest, ["site", "key"])


def noindex_entries(s: Site) -> DataFrame:
    return _values(_listed_pages(s).where("p.noindex"), "loc")


def sitemap_entry_noindex(s: Site) -> DataFrame:
    return _sample_of(noindex_entries(s))


def non_canonical_entries(s: Site) -> DataFrame:
    return _values(_listed_pages(s).where(F.coalesce(F.col("p.canonical_key") != F.col("key"), F.lit(False))), "loc")


def sitemap_entry_non_canonical(s: Site) -> DataFrame:
    return _sample_of(non_canonical_entries(s))


def orphans(s: Site) -> DataFrame:
    listed = _with_parsed(s).select("site", U.same_page_key(F.col("u")).alias("key"))
    pages = _keyed_pages(s).where(~says_noindex()).join(s.entries.select("site").distinct(), "site", "left_semi")
    return _values(pages.join(listed, ["site", "key"], "left_anti"), "page_url")


def sitemap_orphans(s: Site) -> DataFrame:
    return _sample_of(orphans(s))


def _dead(status: Column) -> Column:
    return (status == 0) | (status >= 400)


def unreachable_entries(s: Site) -> DataFrame:
    return _values(s.probes.where(_dead(F.col("status"))), "loc")


def sitemap_entry_unreachable(s: Site) -> DataFrame:
    return _sample_of(unreachable_entries(s))


def redirected_entries(s: Site) -> DataFrame:
    return _values(s.probes.where(~_dead(F.col("status")) & (F.col("final_url") != F.col("loc"))), "loc")


def sitemap_entry_redirects(s: Site) -> DataFrame:
    return _sample_of(redirected_entries(s))


RULES: list[SiteRule] = [
    SiteRule("hreflang.missing", "error", "vendor-spec", ("axis",), hreflang_missing),
    SiteRule("hreflang.cluster-incomplete", "warning", "vendor-spec", ("axis", "entries"), hreflang_cluster_incomplete),
    SiteRule("icons.ico.missing", "info", "guideline", ("favicons",), icons_ico_missing),
    SiteRule("robots.blocks-page", "error", "vendor-spec", ("robots", "said"), robots_blocks_page),
    SiteRule("robots.blocks-site", "error", "vendor-spec", ("robots", "said"), robots_blocks_site),
    SiteRule("robotstxt.cross-origin", "warning", "vendor-spec", ("robots",), robotstxt_cross_origin),
    SiteRule("robotstxt.invalid-line", "warning", "spec-required", ("said",), robotstxt_invalid_line),
    SiteRule("robotstxt.oversized", "error", "spec-required", ("robots",), robotstxt_oversized),
    SiteRule("robotstxt.sitemap.relative", "error", "spec-required", ("said",), robotstxt_sitemap_relative),
    SiteRule("robotstxt.unknown-directive", "info", "guideline", ("said",), robotstxt_unknown_directive),
    SiteRule("robotstxt.unreachable", "error", "spec-required", ("robots",), robotstxt_unreachable),
    SiteRule("sitemap.empty", "warning", "guideline", ("sitemaps",), sitemap_empty),
    SiteRule("sitemap.entry.blocked-by-robots", "error", "vendor-spec", ("entries", "robots", "said"), sitemap_entry_blocked_by_robots, values=blocked_entries),
    SiteRule("sitemap.entry.cross-host", "error", "spec-required", ("entries",), sitemap_entry_cross_host, of_entry=cross_host),
    SiteRule("sitemap.entry.invalid-url", "error", "spec-required", ("entries",), sitemap_entry_invalid_url, of_entry=invalid_url),
    SiteRule("sitemap.entry.noindex", "warning", "vendor-spec", ("entries",), sitemap_entry_noindex, values=noindex_entries),
    SiteRule("sitemap.entry.non-canonical", "warning", "vendor-spec", ("entries",), sitemap_entry_non_canonical, values=non_canonical_entries),
    SiteRule("sitemap.entry.out-of-scope", "error", "spec-required", ("entries",), sitemap_entry_out_of_scope, of_entry=out_of_scope),
    SiteRule("sitemap.entry.protocol-mismatch", "warning", "spec-required", ("entries",), sitemap_entry_protocol_mismatch),
    SiteRule("sitemap.entry.redirects", "warning", "guideline", ("probes",), sitemap_entry_redirects, values=redirected_entries),
    SiteRule("sitemap.entry.unreachable", "error", "vendor-spec", ("probes",), sitemap_entry_unreachable, values=unreachable_entries),
    SiteRule("sitemap.field.invalid", "warning", "spec-required", ("entries",), sitemap_field_invalid, of_entry=invalid_field),
    SiteRule("sitemap.index.child-error", "error", "spec-required", ("sitemaps",), sitemap_index_child_error),
    SiteRule("sitemap.lastmod.invalid", "warning", "spec-required", ("entries",), sitemap_lastmod_invalid, of_entry=invalid_lastmod),
    SiteRule("sitemap.limits.exceeded", "error", "spec-required", ("documents",), sitemap_limits_exceeded),
    SiteRule("sitemap.missing", "warning", "guideline", ("sitemaps",), sitemap_missing),
    SiteRule("sitemap.orphans", "warning", "guideline", ("entries",), sitemap_orphans, values=orphans),
    SiteRule("sitemap.unparsable", "error", "spec-required", ("sitemaps",), sitemap_unparsable),
]
#: Questions for a reader; never a verdict.
ADVISORIES: list[SiteRule] = [SiteRule("hreflang.sitemap-mismatch", "info", "guideline", ("axis", "entries"), hreflang_sitemap_mismatch)]


def evaluate(site: Site, rules: list[SiteRule] | None = None) -> DataFrame:
    """(site, rule_id, severity, rigor, page_url, observed) of all rules whose tables are there."""
    chosen = [r for r in (RULES if rules is None else rules) if all(getattr(site, n) is not None for n in r.needs)]
    if not chosen:
        return site.pages.sparkSession.createDataFrame([], "site string, rule_id string, severity string, rigor string, page_url string, observed string")
    site = keyed(site)
    parts = []
    named = lambda rule, rows: rows.withColumn("rule_id", F.lit(rule.id))
    sampled = [named(r, r.values(site)) for r in chosen if r.values is not None]
    of_entry = [r for r in chosen if r.of_entry is not None]
    if of_entry:
        odd = [F.when(r.of_entry(site).isNotNull(), F.struct(r.of_entry(site)["page_url"].alias("page_url"), r.of_entry(site)["v"].alias("v"), F.lit(r.id).alias("rule_id"))) for r in of_entry]
        entries = _with_document(site) if "document_url" in site.entries.columns else site.entries
        sampled.append(entries.select("site", F.explode(F.array_compact(F.array(*odd))).alias("odd")).select("site", "odd.page_url", "odd.v", "odd.rule_id"))
    if sampled:
        values = stored(reduce(DataFrame.unionByName, sampled).where("v is not null").distinct(), "site-values")
        by_id = {r.id: r for r in chosen}
        told = lambda of: F.element_at(F.create_map(*(F.lit(x) for r in by_id.values() for x in (r.id, of(r)))), F.col("rule_id"))
        found = _sampled(values, "v", "rule_id", "site", "page_url")
        parts.append(found.select("site", "rule_id", told(lambda r: r.severity).alias("severity"), told(lambda r: r.rigor).alias("rigor"), "page_url", F.col("sample").alias("observed")))
    for rule in chosen:
        if rule.values is None and rule.of_entry is None:
            rows = rule.find(site)
            severity = F.col("severity") if "severity" in rows.columns else F.lit(rule.severity)
            parts.append(rows.select("site", F.lit(rule.id).alias("rule_id"), severity.alias("severity"), F.lit(rule.rigor).alias("rigor"), "page_url", "observed"))
    return reduce(DataFrame.unionByName, parts)


def tagged(site: Site) -> DataFrame:
    """Candidates for the axis where nothing declares one."""
    return L.candidates(site.pages.select("site", "path", "html_lang"))
