"""The auditor's queries over the driver's tables, and the same in DuckDB's SQL.

A site is an origin. Queries read the whole pages table; what that table cannot
hold (robots files, sitemaps, clusters, probes) comes from small literal tables
that both sides share, joined with the pages where that makes sense.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U
from loomaudit.operators import clusters, coverage, extract, links, locales, robots
from loomaudit.operators.graph import stored
from loomaudit.plans import cards, page_rules, producer, report, site_rules
from loomaudit.sources import sitemaps, snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LOCALES = ["en", "fr", "de", "es"]
ROBOTS = """# literal
User-agent: *
User-agent: probe
Disallow: /fr/
Allow: /fr/1
Disallow: /*?utm_source
Disallow: /de/*.html$
Crawl-delay: 5
Allow: /es/

Sitemap: https://a.example/sitemap.xml
Sitemap:
Disallowed: /x
no separator
User-agent:
User-agent: probe-image
Disallow: /
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- the pages table as declared pages -------------------------------------


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as rules read them, with path and path_query; no probes ran."""
    pages = snapshot.without_probes(extract.declared(extract.raw_pages(snapshot.fetches(spark, sf_dir))))
    return pages.withColumns({"path": F.regexp_extract("page_url", "^[a-z]+://[^/?#]*([^?#]*)", 1), "path_query": F.regexp_extract("page_url", "^[a-z]+://[^/?#]*([^#]*)", 1)})


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, site, url, path) of the pages table, for work on URLs alone: html is not read."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0).alias("site"), "url", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


def no_clusters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, route string")


URLS = """u AS (
  SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '[?][^#]*') AS query FROM pages
), s AS (
  SELECT *, regexp_replace(path, '/+$', '') AS bare, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u
), r AS (
  SELECT *, CASE WHEN bare = '' THEN '/' ELSE bare END || query AS route_key, lower(parts[1]) AS first,
         CASE WHEN regexp_full_match(parts[1], '(?i)[a-z]{2,3}(-[a-z]{2}|-[0-9]{3})?') THEN lower(parts[1]) ELSE 'x-default' END AS locale FROM s
), t AS (
  SELECT *, CASE WHEN locale <> 'x-default' THEN '/' || array_to_string(parts[2:], '/') ELSE path END AS route FROM r
)"""
#: A title as the tokenizer reads it: the first title of the head, references decoded, white space collapsed. The SQL decodes the two named references that the table holds.
TITLES = """w AS (
  SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title FROM t
), x AS (
  SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(raw_title, '&quot;', '"'), '&amp;', chr(1)), '&am', '&am'), chr(1), '&', 'g'), '\\s+', ' ', 'g')) AS title FROM w
)"""
VERDICTS = f"""WITH {URLS}, {TITLES}, v AS (
  SELECT x.*, d.rule_id, d.ord, d.rigor,
    CASE d.rule_id WHEN 'title.missing' THEN CASE WHEN title = '' THEN 'fail' ELSE 'pass' END
      WHEN 'title.length' THEN CASE WHEN title = '' THEN 'na' WHEN length(title) BETWEEN 10 AND 60 THEN 'pass' ELSE 'warn' END
      ELSE d.status END AS status,
    d.severity AS if_bad
  FROM x, (VALUES (0, 'title.missing', 'spec-required', 'error', NULL), (1, 'title.length', 'heuristic', 'warning', NULL), (2, 'description.missing', 'spec-recommended', 'warning', 'fail'),
    (3, 'description.length', 'heuristic', 'warning', 'na'), (4, 'canonical.missing', 'vendor-spec', 'warning', 'fail'), (5, 'canonical.absolute', 'vendor-spec', 'error', 'na'), (6, 'viewport.missing', 'guideline', 'warning', 'fail'),
    (7, 'og.title.missing', 'vendor-spec', 'warning', 'fail'), (8, 'og.description.missing', 'vendor-spec', 'info', 'na'), (9, 'og.image.missing', 'vendor-spec', 'warning', 'fail'), (10, 'og.image.absolute', 'vendor-spec', 'warning', 'na'),
    (11, 'og.image.alt', 'guideline', 'warning', 'na'), (12, 'og.image.alt.caption', 'guideline', 'info', 'na'), (13, 'og.image.dimensions', 'vendor-spec', 'warning', 'na'), (14, 'og.image.ratio', 'vendor-spec', 'warning', 'na'),
    (15, 'og.locale.missing', 'vendor-spec', 'warning', 'na'), (16, 'og.locale.alternates', 'vendor-spec', 'warning', 'na'), (17, 'icons.missing', 'guideline', 'warning', 'fail'), (18, 'icons.apple-touch.missing', 'vendor-spec', 'info', 'na'),
    (19, 'icons.manifest-mismatch', 'guideline', 'info', 'na'), (20, 'og.image.reachable', 'vendor-spec', 'error', 'na'), (21, 'og.image.sizes-mismatch', 'guideline', 'warning', 'na'), (22, 'icons.unreachable', 'vendor-spec', 'warning', 'na'),
    (23, 'icons.sizes-mismatch', 'guideline', 'info', 'na'), (24, 'robots.conflict', 'vendor-spec', 'error', 'na')) AS d(ord, rule_id, rigor, severity, status)
), f AS (
  SELECT *, 'seo-' || substr(sha256(rule_id || chr(0) || route_key || chr(0) || (row_number() OVER (PARTITION BY site, rule_id, url ORDER BY page_id, ord) - 1)::VARCHAR), 1, 10) AS id FROM v WHERE status IN ('fail', 'warn')
)"""


@query("page_titles", f"WITH {URLS}, {TITLES} SELECT url AS page_url, title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS html_lang FROM x")
def page_titles(spark, sf_dir):
    return declared(spark, sf_dir).select("page_url", "title", "html_lang")


@query("page_lint_title", f"{VERDICTS} SELECT url AS page_url, rule_id, status FROM v WHERE rule_id LIKE 'title.%'")
def page_lint_title(spark, sf_dir):
    rules = [r for r in page_rules.page_rules() if r.id.startswith("title.")]
    return page_rules.evaluate(declared(spark, sf_dir), rules, facts=False).select("page_url", "rule_id", "status")


@query("page_lint_all", f"{VERDICTS} SELECT id, url AS page_url, rule_id, if_bad AS severity, rigor FROM f")
def page_lint_all(spark, sf_dir):
    return report.page_findings(page_rules.evaluate(declared(spark, sf_dir), facts=False)).select("id", "page_url", "rule_id", "severity", "rigor")


def _profiled(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = page_rules.under_profile(page_rules.page_rules(), name)
        return report.page_findings(page_rules.evaluate(declared(spark, sf_dir), rules, facts=False)).groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))

    return run


PROFILE_SQL = {
    "strict": "CASE WHEN rigor IN ('spec-required', 'spec-recommended', 'vendor-spec') THEN 'error' ELSE 'warning' END",
    "spec-only": "if_bad",
    "marketing": "CASE WHEN rule_id IN ('description.missing', 'og.title.missing', 'og.image.missing') THEN 'error' ELSE if_bad END",
}
for _name, _severity in PROFILE_SQL.items():
    _where = "WHERE rigor <> 'heuristic'" if _name == "spec-only" else ""
    query(f"profile_overlay_{_name.replace('-', '_')}", f"{VERDICTS} SELECT rule_id, {_severity} AS severity, count(*) AS findings FROM f {_where} GROUP BY ALL")(_profiled(_name))


@query("conformance_totals", f"{VERDICTS} SELECT rule_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'na') AS not_applicable, 0::BIGINT AS crashed, count(*) AS pages FROM v GROUP BY rule_id")
def conformance_totals(spark, sf_dir):
    return report.conformance(page_rules.evaluate(declared(spark, sf_dir), facts=False))


@query("conformance_matrix", f"{VERDICTS} SELECT url AS page_url, rule_id, status FROM v")
def conformance_matrix(spark, sf_dir):
    return page_rules.evaluate(declared(spark, sf_dir), facts=False).select("page_url", "rule_id", "status")


@query("findings_fingerprints", f"{VERDICTS} SELECT id, count(*) AS findings FROM f GROUP BY id")
def findings_fingerprints(spark, sf_dir):
    return report.page_findings(page_rules.evaluate(declared(spark, sf_dir), facts=False)).groupBy("id").agg(F.count("*").alias("findings"))


@query(
    "findings_rollup_by_rule",
    f"""{VERDICTS}, n AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY url, id) AS n FROM f)
SELECT rule_id, min(if_bad) AS severity, count(*) AS findings, string_agg(url, ' ' ORDER BY url) FILTER (n <= 5) AS pages, greatest(count(*) - 5, 0) AS more FROM n GROUP BY rule_id""",
)
def findings_rollup_by_rule(spark, sf_dir):
    return report.rollup_by_rule(report.page_findings(page_rules.evaluate(declared(spark, sf_dir), facts=False))).drop("first")


@query(
    "audit_summary_verdict",
    f"""{VERDICTS}, c AS (SELECT site, count(*) AS page_issues, count(*) FILTER (if_bad = 'error') AS errors FROM f GROUP BY site), p AS (SELECT site, count(*) AS pages FROM t GROUP BY site)
SELECT site, pages, 0::BIGINT AS broken_links, 0::BIGINT AS missing_translations, coalesce(page_issues, 0) AS page_issues, 0::BIGINT AS site_issues, 0::BIGINT AS unreachable_pages, coalesce(errors, 0) AS errors, coalesce(page_issues, 0) AS findings,
  CASE WHEN coalesce(errors, 0) > 0 THEN 'red' WHEN coalesce(page_issues, 0) > 0 THEN 'yellow' ELSE 'green' END AS verdict FROM p LEFT JOIN c USING (site)""",
)
def audit_summary_verdict(spark, sf_dir):
    pages = declared(spark, sf_dir)
    return report.summary(pages.select("site"), pages, report.page_findings(page_rules.evaluate(pages, facts=False)))


@query("findings_of_heads", f"{VERDICTS} SELECT url AS page_url, count(*) AS head, 0::BIGINT AS others FROM f GROUP BY url")
def findings_of_heads(spark, sf_dir):
    return report.head_findings(report.page_findings(page_rules.evaluate(declared(spark, sf_dir), facts=False)))


@query("advisories", f"WITH {URLS}, {TITLES} SELECT 'advisory-' || substr(sha256(a.rule_id || chr(0) || route_key), 1, 10) AS id, a.rule_id, url AS page_url, 'needs-judgment' AS status FROM x, (VALUES ('title.descriptive'), ('lang.matches-content')) AS a(rule_id) WHERE a.rule_id <> 'title.descriptive' OR title <> ''")
def advisories(spark, sf_dir):
    return page_rules.advisories(declared(spark, sf_dir)).drop("evidence")


@query(
    "baseline_diff",
    f"""{VERDICTS}, b AS (SELECT DISTINCT id FROM f WHERE severity_ok), c AS (SELECT DISTINCT id FROM f WHERE rule_id <> 'viewport.missing')
SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'resolved' ELSE 'kept' END AS change FROM b FULL JOIN c ON b.id = c.id""".replace("severity_ok", "if_bad = 'warning' AND rule_id <> 'icons.missing'"),
)
def baseline_diff(spark, sf_dir):
    """A run without one rule against a baseline without another."""
    found = stored(report.page_findings(page_rules.evaluate(declared(spark, sf_dir))).select(*report.FINDINGS), "findings")
    return report.difference(found.where("severity = 'warning' and rule_id <> 'icons.missing'"), found.where("rule_id <> 'viewport.missing'")).select("id", "change")


# ---- URLs --------------------------------------------------------------------


@query("url_same_page_key", f"WITH {URLS} SELECT url, site || CASE WHEN length(path) > 1 THEN bare ELSE path END || query AS key FROM t")
def url_same_page_key(spark, sf_dir):
    return urls(spark, sf_dir).select("url", U.same_page_key(U.parsed(F.col("url"))).alias("key"))


@query("url_route_key", f"WITH {URLS} SELECT url, route_key AS key FROM t")
def url_route_key(spark, sf_dir):
    return urls(spark, sf_dir).select("url", U.route_key(U.parsed(F.col("url")), F.col("url")).alias("key"))


@query("url_target_key", f"WITH {URLS} SELECT url, site || route_key AS key FROM t")
def url_target_key(spark, sf_dir):
    return urls(spark, sf_dir).select("url", U.target_key(U.parsed(F.col("url")), F.col("url")).alias("key"))


@query("url_duplicate_groups", f"WITH {URLS} SELECT route_key AS key, count(*) AS pages, count(DISTINCT site) AS sites FROM t GROUP BY 1 HAVING count(*) > 1")
def url_duplicate_groups(spark, sf_dir):
    keyed = urls(spark, sf_dir).withColumn("key", U.route_key(U.parsed(F.col("url")), F.col("url")))
    return keyed.groupBy("key").agg(F.count("*").alias("pages"), F.count_distinct("site").alias("sites")).where("pages > 1")


@query("url_route_locale_split", f"WITH {URLS} SELECT url, route, locale FROM t")
def url_route_locale_split(spark, sf_dir):
    return urls(spark, sf_dir).withColumn("at", U.split_route(F.col("path"))).select("url", "at.route", "at.locale")


@query("glob_filter", f"WITH {URLS} SELECT url FROM t WHERE NOT regexp_full_match(path, '/fr/.*') AND (regexp_full_match(path, '/[^/]*/[0-9][^/]') OR regexp_full_match(path, '.*[.]html'))")
def glob_filter(spark, sf_dir):
    return urls(spark, sf_dir).where(X.path_allowed(F.col("path"), ["/*/??", "**.html"], ["/fr/**"])).where(F.col("path").rlike(r"^/[^/]*/\d[^/]$|\.html$")).select("url")


# ---- locales -------------------------------------------------------------------


@query("locale_axis", f"WITH {URLS} SELECT DISTINCT site, locale, 'sitemap' AS source FROM t WHERE locale <> 'x-default'")
def locale_axis(spark, sf_dir):
    return locales.axis(urls(spark, sf_dir))


@query(
    "locale_candidates",
    f"""WITH {URLS}, g AS (SELECT site, locale AS tag, lower(regexp_extract(html, '<html lang="([^"]*)"', 1)) AS lang FROM t WHERE locale <> 'x-default')
SELECT site, tag, count(*) AS pages, true AS known_language, bool_or(lang = tag) AS lang_agrees, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM g GROUP BY site, tag""",
)
def locale_candidates(spark, sf_dir):
    return locales.candidates(declared(spark, sf_dir))


MATRIX = f"""WITH {URLS}, k AS (SELECT site, route, locale, arg_min(url, page_id) AS url FROM t GROUP BY ALL), g AS (
  SELECT a.site, a.route, b.locale FROM (SELECT DISTINCT site, route FROM k) a JOIN (SELECT DISTINCT site, locale FROM k) b USING (site)
), m AS (SELECT g.site, g.route, g.locale, k.url, k.url IS NOT NULL AS inspected, CASE WHEN k.url IS NOT NULL THEN 'crawled' END AS source FROM g LEFT JOIN k USING (site, route, locale))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = stored(declared(spark, sf_dir).select("site", "page_url", "visit_ord", "path", "alternates"), "declared")
    return stored(locales.filled(pages, pages.select("site", F.col("page_url").alias("url"), "path").where("false"), no_clusters(spark)), "cells")


@query("i18n_matrix", f"{MATRIX} SELECT * FROM m")
def i18n_matrix(spark, sf_dir):
    return locales.gridded(cells(spark, sf_dir))


@query(
    "translation_holes",
    f"""{MATRIX}, h AS (SELECT site, route, string_agg(locale, ',' ORDER BY locale) FILTER (url IS NOT NULL) AS present, string_agg(locale, ',' ORDER BY locale) FILTER (url IS NULL) AS missing FROM m WHERE locale <> 'x-default' GROUP BY site, route)
SELECT 'i18n-' || substr(sha256('hole' || chr(0) || route), 1, 10) AS id, * FROM h WHERE present IS NOT NULL AND missing IS NOT NULL""",
)
def translation_holes(spark, sf_dir):
    return locales.holes(cells(spark, sf_dir))


@query("hreflang_missing", f"WITH {URLS}, m AS (SELECT site FROM t WHERE locale <> 'x-default' GROUP BY site HAVING count(DISTINCT locale) >= 2) SELECT site, url AS page_url FROM t SEMI JOIN m USING (site)")
def hreflang_missing(spark, sf_dir):
    site = site_rules.Site(declared(spark, sf_dir), F.lit("2026-01-01").cast("timestamp"), axis=locales.axis(urls(spark, sf_dir)))
    return site_rules.hreflang_missing(site).select("site", "page_url")


@query(
    "locale_suggestions",
    f"""WITH {URLS}, g AS (SELECT site, locale AS tag, lower(regexp_extract(html, '<html lang="([^"]*)"', 1)) AS lang FROM t WHERE locale <> 'x-default'),
c AS (SELECT site, tag FROM g GROUP BY site, tag HAVING bool_or(lang = tag)) SELECT site, string_agg(tag, ',' ORDER BY tag) AS locales FROM c GROUP BY site HAVING count(*) >= 2""",
)
def locale_suggestions(spark, sf_dir):
    return locales.suggested(locales.candidates(declared(spark, sf_dir)))


# ---- coverage ------------------------------------------------------------------

COVERAGE = f"""WITH {URLS}, steps AS (SELECT site, url, unnest(parts) AS segment, generate_subscripts(parts, 1) - 1 AS depth, parts FROM t), e AS (
  SELECT site, url, depth, segment, array_to_string(parts[1:depth], '/') AS prefix FROM steps
), varies AS (SELECT site, depth, prefix FROM e WHERE depth > 0 GROUP BY ALL HAVING count(DISTINCT segment) >= 8), p AS (
  SELECT e.site, e.url, '/' || string_agg(CASE WHEN v.site IS NULL THEN segment ELSE '{{' || e.depth || '}}' END, '/' ORDER BY e.depth) AS pattern FROM e LEFT JOIN varies v USING (site, depth, prefix) GROUP BY ALL
), n AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY site, pattern) AS size FROM p WINDOW w AS (PARTITION BY site, pattern ORDER BY url)), c AS (
  SELECT *, size < 8 OR place IN (0, floor((size - 1) / 2 + 0.5), size - 1) AS keep FROM n
)"""


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.selected(coverage.patterned(urls(spark, sf_dir)))


@query("coverage_families", f"{COVERAGE} SELECT site, pattern, count(*) AS size, count(*) FILTER (keep) AS sampled FROM c WHERE size >= 8 GROUP BY ALL")
def coverage_families(spark, sf_dir):
    return coverage.families(covered(spark, sf_dir))


@query("coverage_selection", f"{COVERAGE} SELECT url, pattern, keep FROM c")
def coverage_selection(spark, sf_dir):
    return covered(spark, sf_dir).select("url", "pattern", "keep")


# ---- links ---------------------------------------------------------------------

LINKS = f"""WITH {URLS}, a AS (SELECT site, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS n FROM t), l AS (
  SELECT site, page_url, n, raw, site || replace(replace(replace(url_encode(replace(replace(replace(raw, '&amp;', '&'), '&lt;', '<'), '&gt;', '>')), '%2F', '/'), '%2C', ','), '%21', '!') AS enc FROM a
), o AS (SELECT site, page_url, n, raw, replace(replace(replace(replace(replace(replace(replace(replace(replace(enc, '%3A', ':'), '%3B', ';'), '%40', '@'), '%26', '&'), '%3D', '='), '%2B', '+'), '%24', '$'), '%2A', '*'), '%7C', '|') AS url FROM l)"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.occurrences(declared(spark, sf_dir))


def known_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that read them more than once."""
    return stored(occurrences(spark, sf_dir).select("page_url", "url", "kind"), "occurrences")


@query("link_occurrences", f"{LINKS} SELECT page_url, raw, url, 'internal' AS kind FROM o")
def link_occurrences(spark, sf_dir):
    return occurrences(spark, sf_dir).select("page_url", "raw", "url", "kind")


@query("link_target_dedupe", f"{LINKS} SELECT url, count(*) AS uses, min(page_url) AS first_page FROM o GROUP BY url")
def link_target_dedupe(spark, sf_dir):
    return links.targets(occurrences(spark, sf_dir)).select("url", "uses", "first_page")


#: A status for each target that both sides derive from its text alone: the table has no answers.
STATUS = "CASE length(url) % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 0 ELSE 200 END"
VERDICT = "CASE length(url) % 5 WHEN 0 THEN 'broken' WHEN 1 THEN 'blocked' WHEN 2 THEN 'broken' ELSE 'ok' END"


def checked(found: DataFrame) -> DataFrame:
    answers = found.select("url").distinct().select("url", F.expr(STATUS).alias("status"), F.lit(None).cast("string").alias("location"), F.lit("").alias("body"))
    return links.checks(found, answers)


@query("link_rows", f"{LINKS} SELECT url, {VERDICT} AS verdict, 'internal' AS kind, regexp_extract(url, '://([^/?#]*)', 1) AS host, count(DISTINCT page_url) AS \"references\" FROM o GROUP BY url")
def link_rows(spark, sf_dir):
    found = known_occurrences(spark, sf_dir)
    return links.rows(checked(found), found)


@query("link_verdict_tally", f"{LINKS}, c AS (SELECT DISTINCT url FROM o), n AS (SELECT {VERDICT} AS verdict, count(*) AS links FROM c GROUP BY 1) SELECT v.verdict, coalesce(links, 0) AS links FROM (VALUES ('ok'), ('redirect'), ('broken'), ('blocked'), ('warning'), ('skipped')) AS v(verdict) LEFT JOIN n USING (verdict)")
def link_verdict_tally(spark, sf_dir):
    return links.tally(checked(known_occurrences(spark, sf_dir)))


BROKEN = f"{LINKS}, b AS (SELECT DISTINCT page_url, url, {VERDICT} AS verdict FROM o WHERE {VERDICT} <> 'ok')"


@query("links_broken_by_page", f"{BROKEN} SELECT page_url, url, verdict FROM b")
def links_broken_by_page(spark, sf_dir):
    found = known_occurrences(spark, sf_dir)
    return links.broken_by_page(found, checked(found)).select("page_url", "url", "verdict")


@query("link_rollup", f"{BROKEN}, n AS (SELECT *, row_number() OVER (PARTITION BY url, verdict ORDER BY page_url) AS n FROM b) SELECT url, verdict, count(*) AS pages, string_agg(page_url, ' ' ORDER BY page_url) FILTER (n <= 5) AS sample, greatest(count(*) - 5, 0) AS more FROM n GROUP BY ALL")
def link_rollup(spark, sf_dir):
    found = known_occurrences(spark, sf_dir)
    return report.rollup_links(stored(links.broken_by_page(found, checked(found)), "broken"))


@query("links_outside_page_set", f"{LINKS} SELECT DISTINCT url FROM o ANTI JOIN (SELECT site || CASE WHEN length(path) > 1 THEN bare ELSE path END || query AS url FROM t) p USING (url)")
def links_outside_page_set(spark, sf_dir):
    pages = urls(spark, sf_dir).select(U.same_page_key(U.parsed(F.col("url"))).alias("key"))
    found = occurrences(spark, sf_dir).select("url").distinct().withColumn("key", U.same_page_key(U.parsed(F.col("url"))))
    return found.join(pages, "key", "left_anti").select("url")


# ---- robots ----------------------------------------------------------------------


def said(spark: SparkSession, site: str = "https://a.example") -> DataFrame:
    return robots.lines(spark.createDataFrame([(site, ROBOTS)], "site string, body string"))


@query(
    "robots_decision",
    f"""WITH {URLS}, d AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM t), m AS (
  SELECT page_id, rule, line, allows, length(rule) AS octets FROM d, (VALUES ('^/fr/.*', '/fr/', 4, false), ('^/fr/1.*', '/fr/1', 5, true), ('^/.*[?]utm_source.*', '/*?utm_source', 6, false), ('^/de/.*[.]html', '/de/*.html$', 7, false), ('^/es/.*', '/es/', 9, true)) AS r(regex, rule, line, allows)
  WHERE regexp_full_match(path, regex)
), b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY octets DESC, allows DESC) AS n FROM m)
SELECT d.page_id, d.path, coalesce(b.allows, true) AS allowed, b.rule FROM d LEFT JOIN b ON b.page_id = d.page_id AND b.n = 1""",
)
def robots_decision(spark, sf_dir):
    """One literal file for all sites."""
    paths = urls(spark, sf_dir).select("page_id", F.lit("https://a.example").alias("site"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1).alias("path"))
    return robots.decisions(paths, said(spark)).select("page_id", "path", "allowed", "rule")


# ---- sitemaps ----------------------------------------------------------------------


#: Literal tables for what the pages cannot say: sections (first path segments) that no sitemap lists, that no crawl has seen, and the answers that a link check has for the URLs of a kind.
UNLISTED, UNCRAWLED, ANSWERED = [("es",)], [("de",)], [(".html", 404)]


def _in_section(spark: SparkSession, rows: DataFrame, sections: list[tuple[str]], how: str) -> DataFrame:
    return rows.withColumn("section", F.split_part("path", F.lit("/"), F.lit(2))).join(F.broadcast(spark.createDataFrame(sections, "section string")), "section", how).drop("section")


def listed(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """The pages as the entries of each site's sitemap, without the unlisted sections unless whole; fields follow from page_id."""
    rows = urls(spark, sf_dir)
    return (rows if whole else _in_section(spark, rows, UNLISTED, "left_anti")).select(
        "site", F.concat("site", F.lit("/en/sitemap.xml")).alias("document_url"), F.col("url").alias("loc"), F.expr("CASE page_id % 4 WHEN 0 THEN '2020-01-01' WHEN 1 THEN 'yesterday' WHEN 2 THEN '2999-01-01T00:00:00Z' END").alias("lastmod"),
        F.expr("CASE page_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'often' END").alias("changefreq"), F.expr("CASE page_id % 5 WHEN 0 THEN '0.5' WHEN 1 THEN '2' WHEN 2 THEN 'x' END").alias("priority"), F.array().cast("array<struct<hreflang: string, href: string>>").alias("alternates"), F.col("page_id").cast("int").alias("ord"),
    )


EVERY = f"WITH {URLS}, e AS (SELECT *, CASE page_id % 4 WHEN 0 THEN '2020-01-01' WHEN 1 THEN 'yesterday' WHEN 2 THEN '2999-01-01T00:00:00Z' END AS lastmod, CASE page_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'often' END AS changefreq, CASE page_id % 5 WHEN 0 THEN '0.5' WHEN 1 THEN '2' WHEN 2 THEN 'x' END AS priority FROM t)"
LISTED = EVERY[:-1] + " WHERE split_part(path, '/', 2) <> 'es')"


def listed_site(spark: SparkSession, sf_dir: str, often: bool = False, whole: bool = True) -> site_rules.Site:
    """often: for many rules; what they all read is written once."""
    pages, entries, axis = declared(spark, sf_dir), listed(spark, sf_dir, whole), locales.axis(urls(spark, sf_dir))
    if often:
        pages = pages.select("site", "page_url", "path_query", "visit_ord", "canonical", "alternates", "robots", "googlebot", "x_robots")
        pages, entries, axis = (stored(t, n) for t, n in ((pages, "declared"), (entries, "entries"), (axis, "axis")))
    return site_rules.Site(pages, F.lit("2026-01-01").cast("timestamp"), entries=entries, axis=axis)


def _sampled_sql(value: str, where: str) -> str:
    return f"""{EVERY}, x AS (SELECT site, {value} AS v FROM e WHERE {where}), n AS (SELECT DISTINCT site, v FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY v) AS n FROM n)
SELECT site, string_agg(v, ' ' ORDER BY v) FILTER (n <= 5) || ' (' || count(*) || ')' AS observed FROM k GROUP BY site"""


@query("sitemap_field_checks", _sampled_sql("url", "changefreq = 'often' OR priority IN ('2', 'x')"))
def sitemap_field_checks(spark, sf_dir):
    return site_rules.sitemap_field_invalid(listed_site(spark, sf_dir)).select("site", "observed")


@query("sitemap_lastmod_checks", _sampled_sql("lastmod", "lastmod IN ('yesterday', '2999-01-01T00:00:00Z')"))
def sitemap_lastmod_checks(spark, sf_dir):
    return site_rules.sitemap_lastmod_invalid(listed_site(spark, sf_dir)).select("site", "observed")


@query("sitemap_out_of_scope", _sampled_sql("url", "path NOT LIKE '/en/%'"))
def sitemap_out_of_scope(spark, sf_dir):
    return site_rules.sitemap_entry_out_of_scope(listed_site(spark, sf_dir)).select("site", "observed")


@query(
    "sitemap_orphans",
    f"""{LISTED}, o AS (SELECT DISTINCT t.site, t.url AS v FROM t SEMI JOIN e ON e.site = t.site ANTI JOIN (SELECT site || CASE WHEN length(path) > 1 THEN bare ELSE path END || query AS key FROM e) x ON x.key = t.site || CASE WHEN length(t.path) > 1 THEN t.bare ELSE t.path END || t.query),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY v) AS n FROM o) SELECT site, string_agg(v, ' ' ORDER BY v) FILTER (n <= 5) || ' (' || count(*) || ')' AS observed FROM k GROUP BY site""",
)
def sitemap_orphans(spark, sf_dir):
    return site_rules.sitemap_orphans(listed_site(spark, sf_dir, whole=False)).select("site", "observed")


PROBED = "WITH {URLS}, e AS (SELECT site, url AS loc, path, page_id FROM t), p AS (SELECT DISTINCT url FROM t WHERE split_part(path, '/', 2) <> 'de'), x AS (SELECT e.*, p.url IS NOT NULL AS crawled, e.path LIKE '%.html' AS linked FROM e LEFT JOIN p ON p.url = e.loc)"


def _probed(spark: SparkSession, sf_dir: str):
    """Every listed URL, the pages outside the uncrawled sections as the crawl, and the answers of a link check."""
    pages = _in_section(spark, urls(spark, sf_dir), UNCRAWLED, "left_anti").select(F.col("url").alias("page_url"), F.lit(200).alias("status"))
    kinds = F.broadcast(spark.createDataFrame(ANSWERED, "ending string, status int"))
    answers = urls(spark, sf_dir).withColumn("ending", F.regexp_extract("path", "[.][a-z]+$", 0)).join(kinds, "ending").select("url", "status", F.col("url").alias("final_url"))
    return links.entry_probes(listed(spark, sf_dir), pages, answers, budget=1), pages


@query("sitemap_entry_probes", PROBED.replace("{URLS}", URLS) + " SELECT loc, CASE WHEN crawled THEN 200 ELSE 404 END AS status FROM x WHERE crawled OR linked")
def sitemap_entry_probes(spark, sf_dir):
    return _probed(spark, sf_dir)[0][0].select("loc", "status")


@query("sitemap_entries_unprobed", PROBED.replace("{URLS}", URLS) + " SELECT loc, row_number() OVER (PARTITION BY site ORDER BY page_id, loc) = 1 AS in_budget FROM x WHERE NOT crawled AND NOT linked")
def sitemap_entries_unprobed(spark, sf_dir):
    return _probed(spark, sf_dir)[0][1].select("loc", "in_budget")


@query("sitemap_uncrawled", PROBED.replace("{URLS}", URLS) + " SELECT site, count(*) AS urls FROM x WHERE NOT crawled GROUP BY site")
def sitemap_uncrawled(spark, sf_dir):
    return links.uncrawled(listed(spark, sf_dir), _probed(spark, sf_dir)[1])


def _by_host(entries: DataFrame) -> DataFrame:
    """Entries of one sitemap for each host, whatever their scheme."""
    host = F.regexp_extract("loc", "://([^/?#]*)", 1)
    return entries.withColumns({"site": host, "document_url": F.concat(F.lit("https://"), F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.lit("/sitemap.xml"))})


@query("sitemap_protocol_mismatch", f"{EVERY} SELECT regexp_extract(url, '://([^/?#]*)', 1) AS site, 'http,https' AS observed FROM e GROUP BY 1 HAVING count(DISTINCT split_part(url, '://', 1)) > 1")
def sitemap_protocol_mismatch(spark, sf_dir):
    site = site_rules.Site(declared(spark, sf_dir), F.lit("2026-01-01").cast("timestamp"), entries=_by_host(listed(spark, sf_dir)))
    return site_rules.sitemap_entry_protocol_mismatch(site).select("site", "observed")


@query(
    "sitemap_cross_host",
    f"""{EVERY}, n AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS site, url AS v FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY v) AS n FROM n WHERE regexp_matches(site, '^(www|m|blog)[.]'))
SELECT site, string_agg(v, ' ' ORDER BY v) FILTER (n <= 5) || ' (' || count(*) || ')' AS observed FROM k GROUP BY site""",
)
def sitemap_cross_host(spark, sf_dir):
    site = site_rules.Site(declared(spark, sf_dir), F.lit("2026-01-01").cast("timestamp"), entries=_by_host(listed(spark, sf_dir)))
    return site_rules.sitemap_entry_cross_host(site).select("site", "observed")


@query("site_lint", f"{LISTED}, m AS (SELECT site FROM t WHERE locale <> 'x-default' GROUP BY site HAVING count(DISTINCT locale) >= 2) SELECT rule_id, count(*) AS findings FROM (SELECT 'hreflang.missing' AS rule_id FROM t SEMI JOIN m USING (site) UNION ALL SELECT DISTINCT ON (site) 'sitemap.field.invalid' FROM e WHERE changefreq = 'often' OR priority IN ('2', 'x') UNION ALL SELECT DISTINCT ON (site) 'sitemap.lastmod.invalid' FROM e WHERE page_id % 4 IN (1, 2) UNION ALL SELECT DISTINCT ON (site) 'sitemap.entry.out-of-scope' FROM e WHERE path NOT LIKE '/en/%' UNION ALL (SELECT DISTINCT ON (t.site) 'sitemap.orphans' FROM t SEMI JOIN e ON e.site = t.site ANTI JOIN (SELECT site || CASE WHEN length(path) > 1 THEN bare ELSE path END || query AS key FROM e) x ON x.key = t.site || CASE WHEN length(t.path) > 1 THEN t.bare ELSE t.path END || t.query)) GROUP BY 1")
def site_lint(spark, sf_dir):
    return report.site_findings(site_rules.evaluate(listed_site(spark, sf_dir, often=True, whole=False))).groupBy("rule_id").agg(F.count("*").alias("findings"))


@query("title_fit", f"WITH {URLS}, {TITLES} SELECT url AS page_url, CASE WHEN length(title) <= 20 THEN 72 WHEN length(title) <= 40 THEN 56 WHEN length(title) <= 60 THEN 44 ELSE 36 END AS size FROM x")
def title_fit(spark, sf_dir):
    size = cards.fitted_size(X.grapheme_count(F.col("title")), [(20, 72), (40, 56), (60, 44)], 36)
    return declared(spark, sf_dir).select("page_url", size.alias("size"))


@query("share_cards", f"WITH {URLS}, {TITLES} SELECT url AS page_url, s.surface, title, 'document' AS title_from FROM x, (VALUES ('open-graph'), ('search'), ('x'), ('linkedin'), ('slack'), ('discord'), ('whatsapp')) AS s(surface)")
def share_cards(spark, sf_dir):
    return cards.cards(declared(spark, sf_dir)).select("page_url", "surface", "title", "title_from")


# ---- pages with heads of all kinds ------------------------------------------------


def _by(n: int, *kinds: str, each: int = 1) -> "F.Column":
    """The (page_id / each mod n)-th of kinds; {p} in it is the page's number."""
    place = F.pmod(F.floor(F.col("visit_ord") / each), F.lit(n))
    return F.element_at(F.array(*(F.replace(F.lit(k), F.lit("{p}"), F.col("visit_ord").cast("string")) for k in kinds)), (place + 1).cast("int"))


CDN = "https://cdn.example"
LONG = "A description that says enough of a page to stand alone in a list of results, and no more."


def _meta(**content: str) -> str:
    return "".join(f'<meta {"property" if k.startswith("og_") else "name"}="{k.replace("_n_", "_").replace("_", ":")}" content="{v}">' for k, v in content.items())


def _image(url: str, *pairs: tuple[str, str]) -> str:
    return f'<meta property="og:image" content="{url}">' + "".join(f'<meta property="og:image:{k}" content="{v}">' for k, v in pairs)


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table with a head for each page that follows from its number, as declared pages with probes of literal assets: the table itself declares little."""
    size = lambda w, h: (("width", w), ("height", h))
    head = F.concat(
        _by(5, "", _meta(description="short"), _meta(description="A description of thirty chars."), _meta(description=LONG), _meta(description="  ")),
        _by(4, "", '<link rel="canonical" href="https://a.example/{p}">', '<link rel="canonical" href="/{p}">', '<link rel="canonical" href="">', each=5),
        _by(3, "", _meta(viewport="width=device-width"), _meta(viewport=" ")),
        _by(3, "", _meta(og_title="Card {p}"), _meta(og_title=" "), each=3),
        _by(2, "", _meta(og_description="d"), each=2),
        _by(
            6, "", _image(f"{CDN}/1.png", *size("1200", "630"), ("alt", "A view")), _image("/i2.png"), _image(f"{CDN}/3.png", *size("600", "600"), ("alt", "Card {p}")),
            _image(f"{CDN}/4.png", ("secure_url", "/4.png"), ("alt", " "), *size("100", "900")), _image(f"{CDN}/5.png", ("alt", "Another"), *size("1910px", "1000")) + _image("6.png", ("width", "20")), each=7,
        ),
        _by(4, "", _meta(og_locale="fr_FR") + '<meta property="og:locale:alternate" content="en_US">', _meta(og_locale="fr_FR"), _meta(og_locale="en") + '<meta property="og:locale:alternate" content="de_DE">', each=11),
        _by(3, "", f'<link rel="alternate" hreflang="en" href="{CDN}/en"><link rel="alternate" hreflang="fr" href="{CDN}/fr">', f'<link rel="alternate" hreflang="en" href="{CDN}/en">', each=13),
        _by(
            4, "", f'<link rel="icon" href="{CDN}/i.png" sizes="32x32" type="image/png">', f'<link rel="icon" href="{CDN}/i.png" sizes="16x16" type="image/png"><link rel="apple-touch-icon" href="{CDN}/apple.png">',
            f'<link rel="apple-touch-icon" href="{CDN}/apple.png">', each=3,
        ),
        _by(2, "", f'<link rel="manifest" href="{CDN}/m.json">', each=17),
        _by(5, "", _meta(robots="noindex", googlebot="index"), _meta(robots="noindex, Follow", googlebot="nofollow"), _meta(robots="index", googlebot="index"), _meta(robots="index"), each=19),
    )
    fetched = snapshot.fetches(spark, sf_dir).withColumn("html", F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))))
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    assets = [("1.png", 200, png(1200, 630)), ("3.png", 404, b""), ("5.png", 200, png(1000, 500)), ("i.png", 200, png(32, 32)), ("apple.png", 404, b"")]
    probes = snapshot.asset_probes(spark.createDataFrame([(f"{CDN}/{n}", s, "image/png", b) for n, s, b in assets], "url string, status int, content_type string, head binary"))
    manifests = spark.createDataFrame([(f"{CDN}/m.json", 200, '{"icons": [{"src": "/i.png", "sizes": "32x32", "type": "image/png"}, {"src": "/other.png"}]}')], "href string, status int, body string")
    return snapshot.with_probes(extract.declared(extract.raw_pages(fetched)), F.broadcast(probes), F.broadcast(manifests))


#: What each page's number says of its head, as in `dressed`.
DRESSED = f"""WITH {URLS}, {TITLES}, n AS (
  SELECT x.*, page_id % 5 AS d, page_id // 5 % 4 AS c, page_id % 3 AS v, page_id // 3 % 3 AS o, page_id // 2 % 2 AS od, page_id // 7 % 6 AS i, page_id // 11 % 4 AS l, page_id // 13 % 3 AS h, page_id // 3 % 4 AS k, page_id // 17 % 2 AS m, page_id // 19 % 5 AS r FROM x
), g AS (SELECT *, o <> 0 OR i <> 0 AS shared FROM n), q AS (
  SELECT page_id, site, url, title, route_key, o, i, unnest([
    {{'ord': 0, 'rule_id': 'title.missing', 'status': CASE WHEN title = '' THEN 'fail' ELSE 'pass' END}},
    {{'ord': 1, 'rule_id': 'title.length', 'status': CASE WHEN title = '' THEN 'na' WHEN length(title) BETWEEN 10 AND 60 THEN 'pass' ELSE 'warn' END}},
    {{'ord': 2, 'rule_id': 'description.missing', 'status': CASE WHEN d IN (0, 4) THEN 'fail' ELSE 'pass' END}},
    {{'ord': 3, 'rule_id': 'description.length', 'status': CASE WHEN d IN (0, 4) THEN 'na' WHEN d = 3 THEN 'pass' ELSE 'warn' END}},
    {{'ord': 4, 'rule_id': 'canonical.missing', 'status': CASE WHEN c IN (0, 3) THEN 'fail' ELSE 'pass' END}},
    {{'ord': 5, 'rule_id': 'canonical.absolute', 'status': CASE WHEN c IN (0, 3) THEN 'na' WHEN c = 2 THEN 'fail' ELSE 'pass' END}},
    {{'ord': 6, 'rule_id': 'viewport.missing', 'status': CASE WHEN v = 1 THEN 'pass' ELSE 'fail' END}},
    {{'ord': 7, 'rule_id': 'og.title.missing', 'status': CASE WHEN o = 1 THEN 'pass' ELSE 'fail' END}},
    {{'ord': 8, 'rule_id': 'og.description.missing', 'status': CASE WHEN NOT shared THEN 'na' WHEN od = 0 THEN 'fail' ELSE 'pass' END}},
    {{'ord': 9, 'rule_id': 'og.image.missing', 'status': CASE WHEN i = 0 THEN 'fail' ELSE 'pass' END}},
    {{'ord': 10, 'rule_id': 'og.image.absolute', 'status': CASE WHEN i = 0 THEN 'na' WHEN i IN (2, 4, 5) THEN 'fail' ELSE 'pass' END}},
    {{'ord': 11, 'rule_id': 'og.image.alt', 'status': CASE WHEN i = 0 THEN 'na' WHEN i IN (2, 4, 5) THEN 'fail' ELSE 'pass' END}},
    {{'ord': 12, 'rule_id': 'og.image.alt.caption', 'status': CASE WHEN i NOT IN (1, 3, 5) OR o = 2 OR o = 0 AND title = '' THEN 'na' WHEN i = 3 AND o = 1 THEN 'fail' ELSE 'pass' END}},
    {{'ord': 13, 'rule_id': 'og.image.dimensions', 'status': CASE WHEN i = 0 THEN 'na' WHEN i IN (2, 5) THEN 'fail' ELSE 'pass' END}},
    {{'ord': 14, 'rule_id': 'og.image.ratio', 'status': CASE WHEN i IN (0, 2) THEN 'na' WHEN i IN (3, 4) THEN 'warn' ELSE 'pass' END}},
    {{'ord': 15, 'rule_id': 'og.locale.missing', 'status': CASE WHEN h <> 1 OR NOT shared AND l = 0 OR NOT shared THEN 'na' WHEN l = 0 THEN 'fail' ELSE 'pass' END}},
    {{'ord': 16, 'rule_id': 'og.locale.alternates', 'status': CASE WHEN h <> 1 OR l = 0 THEN 'na' WHEN l = 1 THEN 'pass' ELSE 'fail' END}},
    {{'ord': 17, 'rule_id': 'icons.missing', 'status': CASE WHEN k = 0 AND m = 0 THEN 'fail' ELSE 'pass' END}},
    {{'ord': 18, 'rule_id': 'icons.apple-touch.missing', 'status': CASE WHEN k = 0 THEN 'na' WHEN k = 1 THEN 'fail' ELSE 'pass' END}},
    {{'ord': 19, 'rule_id': 'icons.manifest-mismatch', 'status': CASE WHEN m = 0 THEN 'na' WHEN k IN (0, 2) THEN 'fail' ELSE 'pass' END}},
    {{'ord': 20, 'rule_id': 'og.image.reachable', 'status': CASE WHEN i IN (1, 5) THEN 'pass' WHEN i = 3 THEN 'fail' ELSE 'na' END}},
    {{'ord': 21, 'rule_id': 'og.image.sizes-mismatch', 'status': CASE WHEN i = 1 THEN 'pass' WHEN i = 5 THEN 'fail' ELSE 'na' END}},
    {{'ord': 22, 'rule_id': 'icons.unreachable', 'status': CASE WHEN k = 0 THEN 'na' WHEN k = 1 THEN 'pass' ELSE 'fail' END}},
    {{'ord': 23, 'rule_id': 'icons.sizes-mismatch', 'status': CASE WHEN k = 1 THEN 'pass' WHEN k = 2 THEN 'fail' ELSE 'na' END}},
    {{'ord': 24, 'rule_id': 'robots.conflict', 'status': CASE WHEN r IN (0, 4) THEN 'na' WHEN r = 3 THEN 'pass' ELSE 'fail' END}}]) AS f FROM g
)"""


@query("dressed_lint", f"{DRESSED} SELECT url AS page_url, f.rule_id AS rule_id, f.status AS status FROM q")
def dressed_lint(spark, sf_dir):
    return page_rules.evaluate(dressed(spark, sf_dir), facts=False).select("page_url", "rule_id", "status")


@query("dressed_conformance", f"{DRESSED} SELECT f.rule_id AS rule_id, count(*) FILTER (f.status = 'pass') AS passed, count(*) FILTER (f.status = 'fail') AS failed, count(*) FILTER (f.status = 'warn') AS warned, count(*) FILTER (f.status = 'na') AS not_applicable, count(*) AS pages FROM q GROUP BY 1")
def dressed_conformance(spark, sf_dir):
    return report.conformance(page_rules.evaluate(dressed(spark, sf_dir), facts=False)).drop("crashed")


@query(
    "dressed_advisories",
    f"""{DRESSED} SELECT 'advisory-' || substr(sha256(a.rule_id || chr(0) || route_key), 1, 10) AS id, a.rule_id, url AS page_url
FROM g, (VALUES ('title.descriptive'), ('description.accurate'), ('lang.matches-content'), ('og.image.representative')) AS a(rule_id)
WHERE CASE a.rule_id WHEN 'title.descriptive' THEN title <> '' WHEN 'description.accurate' THEN d NOT IN (0, 4) WHEN 'og.image.representative' THEN i <> 0 ELSE true END""",
)
def dressed_advisories(spark, sf_dir):
    return page_rules.advisories(dressed(spark, sf_dir)).select("id", "rule_id", "page_url")


@query(
    "dressed_images",
    f"""{DRESSED} SELECT url AS page_url, v.url AS image, v.width, v.height, replace(v.alt, '#', page_id::VARCHAR) AS alt FROM g JOIN (VALUES (1, 'https://cdn.example/1.png', 1200, 630, 'A view'), (2, '/i2.png', NULL, NULL, NULL),
  (3, 'https://cdn.example/3.png', 600, 600, 'Card #'), (4, 'https://cdn.example/4.png', 100, 900, ' '), (5, 'https://cdn.example/5.png', 1910, 1000, 'Another'), (5, '6.png', 20, NULL, NULL)) AS v(i, url, width, height, alt) USING (i)""".replace("SELECT url AS page_url", "SELECT g.url AS page_url"),
)
def dressed_images(spark, sf_dir):
    return dressed(spark, sf_dir).select("page_url", F.explode("og_images").alias("i")).select("page_url", F.col("i.url").alias("image"), "i.width", "i.height", "i.alt")


# ---- rules of one's own, counts, diagnostics, producer over the pages table --------


def _judge_title(page: dict) -> tuple[str, str]:
    """A literal rule that fails on long titles with an error of its own."""
    title = page["title"] or ""
    if len(title) > 60:
        raise ValueError("too long to judge")
    return ("fail" if "e" in title.lower() else "pass"), title


OWN = f"""WITH {URLS}, {TITLES}, y AS (SELECT *, CASE WHEN length(title) > 60 THEN 'crashed' WHEN contains(lower(title), 'e') THEN 'fail' ELSE 'pass' END AS status FROM x)"""


def _own_rules() -> list[page_rules.Rule]:
    missing = page_rules.Rule("own.unreadable", "heuristic", "own", F.col("no_such_column"), F.lit(""), "error")
    return [page_rules.own_rule("own.title", "warning", ("title",), _judge_title), missing]


@query("own_rule_conformance", f"{OWN} SELECT 'own.title' AS rule_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, 0::BIGINT AS warned, 0::BIGINT AS not_applicable, count(*) FILTER (status = 'crashed') AS crashed, count(*) AS pages FROM y UNION ALL SELECT 'own.unreadable', 0, 0, 0, 0, count(*), count(*) FROM y")
def own_rule_conformance(spark, sf_dir):
    return report.conformance(page_rules.evaluate(declared(spark, sf_dir), _own_rules()))


@query("own_rule_findings", f"{OWN} SELECT url AS page_url, CASE status WHEN 'fail' THEN 'own.title' ELSE 'engine.rule-crashed' END AS rule_id, CASE status WHEN 'fail' THEN 'warning' ELSE 'info' END AS severity, CASE status WHEN 'fail' THEN title ELSE 'rule own.title: too long to judge' END AS summary FROM y WHERE status <> 'pass'")
def own_rule_findings(spark, sf_dir):
    return report.page_findings(page_rules.evaluate(declared(spark, sf_dir), _own_rules()[:1])).select("page_url", "rule_id", "severity", "summary")


@query("severity_counts", f"{VERDICTS} SELECT s.severity, count(f.id) AS findings FROM (VALUES ('error'), ('warning'), ('info')) AS s(severity) LEFT JOIN f ON f.if_bad = s.severity GROUP BY s.severity")
def severity_counts(spark, sf_dir):
    return report.severity_counts(report.page_findings(page_rules.evaluate(declared(spark, sf_dir), facts=False)))


@query("link_hosts", f"{LINKS} SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM o")
def link_hosts(spark, sf_dir):
    found = known_occurrences(spark, sf_dir)
    return links.hosts(links.ordered(links.rows(checked(found), found)))


@query("scan_warnings", f"""WITH {URLS}, c AS (SELECT site, count(*) AS targets, count(*) FILTER (split_part(path, '/', 2) = 'de') AS failed FROM t GROUP BY site)
SELECT *, CASE WHEN failed = targets THEN 'blind' ELSE 'partial' END AS warning FROM c WHERE failed > 0 AND 2 * failed >= targets""")
def scan_warnings(spark, sf_dir):
    """The links of the uncrawled sections could not be read."""
    seen = _in_section(spark, urls(spark, sf_dir), UNCRAWLED, "left_anti").select("page_id", F.lit(True).alias("scanned"))
    return report.scan_warnings(urls(spark, sf_dir).join(seen, "page_id", "left"))


@query("blocked_escalations", f"WITH {URLS} SELECT site, count(*) AS pages, arg_min('no browser for page ' || page_id, page_id) AS reason FROM t WHERE split_part(path, '/', 2) = 'de' GROUP BY site")
def blocked_escalations(spark, sf_dir):
    """The pages of the uncrawled sections would have needed a browser."""
    pages = _in_section(spark, urls(spark, sf_dir), UNCRAWLED, "left_semi")
    return report.blocked_escalations(pages.select("site", F.col("page_id").alias("visit_ord"), F.concat(F.lit("no browser for page "), F.col("page_id").cast("string")).alias("escalation_blocked")))


@query("page_findings_joined", f"{VERDICTS}, p AS (SELECT DISTINCT url FROM x) SELECT p.url AS page_url, f.rule_id FROM p LEFT JOIN f ON f.url = p.url AND f.rule_id LIKE 'title.%'")
def page_findings_joined(spark, sf_dir):
    rules = [r for r in page_rules.page_rules() if r.id.startswith("title.")]
    pages = stored(declared(spark, sf_dir).select("site", "page_url", "visit_ord", "title"), "titles")
    return report.findings_by_page(pages.select("page_url").distinct(), report.page_findings(page_rules.evaluate(pages, rules))).select("page_url", "rule_id")


#: The pages as routes of a producing site: each site a family, each locale-free route a key.
ROUTES = f"""WITH {URLS}, e AS (SELECT DISTINCT site AS family, route AS key, locale, path FROM t WHERE locale <> 'x-default'), k AS (
  SELECT family, key, coalesce(min(locale) FILTER (locale = 'en'), min(locale)) AS anchor FROM e GROUP BY ALL
), z AS (SELECT e.*, locale = anchor AS is_anchor FROM e JOIN k USING (family, key))"""


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = U.split_route(F.col("path"))
    placed = urls(spark, sf_dir).select("site", "path", at["route"].alias("route"), at["locale"].alias("locale")).where("locale <> 'x-default'").distinct()
    made = producer.collection(placed, "", F.col("path"), F.col("locale"), F.col("route")).join(placed.select("path", "site").distinct(), "path")
    return producer.registry(made.withColumn("family", F.col("site")).drop("site").distinct(), "en")


@query("producer_registry", f"{ROUTES} SELECT family, key, locale, path, is_anchor FROM z")
def producer_registry(spark, sf_dir):
    return page_routes(spark, sf_dir).select("family", "key", "locale", "path", "is_anchor")


@query("producer_clusters", f"{ROUTES} SELECT family, key, locale AS tag, 'https://a.example' || path AS url FROM z UNION ALL SELECT family, key, 'x-default', 'https://a.example' || path FROM z WHERE is_anchor")
def producer_clusters(spark, sf_dir):
    return producer.clusters(page_routes(spark, sf_dir), "https://a.example/")


@query("producer_sitemap", f"{ROUTES}, m AS (SELECT family, key, count(*) + count(*) FILTER (is_anchor) AS links FROM z GROUP BY ALL) SELECT 'https://a.example' || path AS loc, sum(links)::BIGINT AS links FROM z JOIN m USING (family, key) GROUP BY 1")
def producer_sitemap(spark, sf_dir):
    return producer.sitemap(page_routes(spark, sf_dir), "https://a.example").groupBy("loc").agg(F.count("*").alias("links"))


@query("producer_clashes", f"{ROUTES}, n AS (SELECT 'several-paths' AS problem, concat_ws('|', family, key, locale) AS value, count(DISTINCT path) AS n FROM z GROUP BY ALL UNION ALL SELECT 'shared-path', path, count(DISTINCT concat_ws('|', family, key, locale)) FROM z GROUP BY path) SELECT * FROM n WHERE n > 1")
def producer_clashes(spark, sf_dir):
    return producer.clashes(page_routes(spark, sf_dir))


@query("producer_metadata", f"{ROUTES}, w AS (SELECT family, key, path AS top FROM z WHERE is_anchor) SELECT path, 'https://a.example' || path AS canonical, CASE locale WHEN 'en' THEN 'en_US' WHEN 'fr' THEN 'fr_FR' WHEN 'de' THEN 'de_DE' ELSE 'es_ES' END AS og_locale, 'A site' AS og_site_name, 'https://a.example' || top AS x_default FROM z JOIN w USING (family, key)")
def producer_metadata(spark, sf_dir):
    return producer.metadata(page_routes(spark, sf_dir), "https://a.example", "A site")


@query(
    "producer_locate",
    f"""{ROUTES}, w AS (SELECT family, key, locale, is_anchor, '/' || replace(family, '://', '/') || path AS path FROM z), a AS (SELECT path, unnest(['en', NULL]) AS locale FROM w UNION ALL SELECT '/nowhere', 'en'),
c AS (SELECT family, key, count(*) FILTER (tag <> 'x-default') AS n, min(locale) AS only, string_agg(tag, ',' ORDER BY tag) AS languages FROM (SELECT family, key, locale, locale AS tag FROM w UNION ALL SELECT family, key, NULL, 'x-default' FROM w WHERE is_anchor) GROUP BY ALL),
j AS (SELECT a.path, a.locale, w.family, w.key, c.n, c.languages, CASE WHEN c.n = 1 THEN c.only ELSE a.locale END AS served FROM a LEFT JOIN w USING (path) LEFT JOIN c ON c.family = w.family AND c.key = w.key)
SELECT j.path, j.locale, 'https://a.example' || b.path AS url, CASE WHEN b.path IS NOT NULL THEN j.languages END AS languages,
       CASE WHEN j.key IS NULL THEN 'no such route' WHEN j.n > 1 AND j.locale IS NULL THEN 'needs a locale' WHEN b.path IS NULL THEN 'not served in this locale' END AS problem
FROM j LEFT JOIN w b ON b.family = j.family AND b.key = j.key AND b.locale = j.served""",
)
def producer_locate(spark, sf_dir):
    """Every page's path below its site's name, asked for in English and without a locale, and a path that is none."""
    routes = page_routes(spark, sf_dir).withColumn("path", F.concat(F.lit("/"), F.replace("family", F.lit("://"), F.lit("/")), F.col("path")))
    routes = stored(routes, "routes")
    asked = routes.select("path", F.explode(F.array(F.lit("en"), F.lit(None).cast("string"))).alias("locale")).unionByName(spark.createDataFrame([("/nowhere", "en")], "path string, locale string"))
    return producer.locate(routes, "https://a.example", asked)


# ---- site rules over sites of all kinds ---------------------------------------------


#: What a site's robots.txt says, by the length of its origin modulo 7.
BODIES = ["User-agent: *\nDisallow:\n"] * 4 + ["User-agent: *\nDisallow: /\n", "User-agent: *\nDisallow: /fr/\nCrawl-delay: 3\nHost: x\nSitemap: /rel.xml\n", "no separator\nUser-agent: *\nAllow: /\nDisallowed: /x\n"]


def dressed_site(spark: SparkSession, sf_dir: str) -> site_rules.Site:
    """The dressed pages, with robots files, sitemaps, probes and icons that follow from the length of each origin."""
    pages = dressed(spark, sf_dir).withColumns({"path": F.regexp_extract("page_url", "^[a-z]+://[^/?#]*([^?#]*)", 1), "path_query": F.regexp_extract("page_url", "^[a-z]+://[^/?#]*([^#]*)", 1)})
    pages = stored(pages.select("site", "page_url", "path", "path_query", "visit_ord", "canonical", "alternates", "robots", "googlebot", "x_robots"), "dressed")
    entries, axis = stored(listed(spark, sf_dir), "entries"), stored(locales.axis(urls(spark, sf_dir)), "axis")
    kind, other = F.length("site") % 7, F.length("site") % 4
    sites = urls(spark, sf_dir).select("site").distinct()
    url = F.concat("site", F.lit("/robots.txt"))
    robots_of = sites.select(
        "site", url.alias("url"), F.when(kind == 0, 0).when(kind == 1, 503).otherwise(200).alias("status"), F.when(kind == 2, "https://elsewhere.example/robots.txt").otherwise(url).alias("final_url"), F.when(kind == 3, 600_000).otherwise(100).alias("bytes"),
    )
    said_by = robots.lines(sites.select("site", F.element_at(F.array(*map(F.lit, BODIES)), (kind + 1).cast("int")).alias("body")))
    maps = sites.select("site", (other >= 2).alias("found"), (other == 1).alias("unparsable"), F.when(other == 3, 10).otherwise(0).alias("urls"), F.when(other == 3, 2).otherwise(0).alias("child_errors"))
    documents = sites.select("site", F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.when(other == 3, 60_000).otherwise(10).alias("entries"), F.lit(1000).alias("bytes"))
    dead = F.col("loc").rlike("^[^?#]*[.]html")
    moved = F.regexp_extract("loc", "^[a-z]+://[^/]*/([^/]*)", 1) == "fr"
    probes = entries.select("site", "loc", F.when(dead, 404).otherwise(200).alias("status"), F.when(moved, F.concat("loc", F.lit("/moved"))).otherwise(F.col("loc")).alias("final_url"))
    return site_rules.Site(
        pages, F.lit("2026-01-01").cast("timestamp"), robots=robots_of, said=stored(said_by, "said"), sitemaps=maps, documents=documents, entries=entries, axis=axis, favicons=sites.select("site", (F.length("site") % 2 == 1).alias("found")), probes=probes,
    )


def _sampled_rule(rule: str, severity: str, value: str, rows: str) -> str:
    return f"""SELECT site, '{rule}' AS rule_id, '{severity}' AS severity, site AS page_url, string_agg(v, ' ' ORDER BY v) FILTER (n <= 5) || ' (' || count(*) || ')' AS observed
FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY v) AS n FROM (SELECT DISTINCT site, {value} AS v FROM {rows})) GROUP BY site"""


DRESSED_SITES = f"""{DRESSED}, sites AS (SELECT DISTINCT site, length(site) % 7 AS kind, length(site) % 4 AS other FROM t),
e AS (SELECT *, site || CASE WHEN length(path) > 1 THEN bare ELSE path END || query AS key FROM g),
latest AS (SELECT site, site || CASE WHEN length(path) > 1 THEN bare ELSE path END || query AS key, arg_max(r, page_id) AS r, arg_max(c, page_id) AS c FROM g GROUP BY ALL),
el AS (SELECT e.site, e.url, latest.r AS lr, latest.c AS lc FROM e JOIN latest USING (site, key)),
said AS (SELECT site, bool_or(r IN (3, 4)) AS claims FROM g GROUP BY site),
multi AS (SELECT site FROM t WHERE locale <> 'x-default' GROUP BY site HAVING count(DISTINCT locale) >= 2),
routes AS (SELECT site, route, list_sort(list(DISTINCT locale)) AS listed FROM e WHERE locale <> 'x-default' GROUP BY ALL),
heads AS (SELECT g.*, CASE h WHEN 1 THEN ['en', 'fr'] ELSE ['en'] END AS head FROM g WHERE h <> 0),
gaps AS (SELECT heads.site, heads.url, heads.head, list_filter(routes.listed, lambda x: NOT list_contains(heads.head, x)) AS gap, list_filter(heads.head, lambda x: NOT list_contains(routes.listed, x)) AS extra FROM heads JOIN routes USING (site, route)),
found AS (
  SELECT site, 'hreflang.missing' AS rule_id, 'error' AS severity, url AS page_url, 'no alternates' AS observed FROM g SEMI JOIN multi USING (site) WHERE h = 0
  UNION ALL SELECT site, 'hreflang.cluster-incomplete', 'warning', url, array_to_string(gap, ',') FROM gaps SEMI JOIN multi USING (site) WHERE len(gap) > 0
  UNION ALL SELECT site, 'icons.ico.missing', 'info', site, '/favicon.ico' FROM sites WHERE length(site) % 2 = 0
  UNION ALL SELECT site, 'robots.blocks-page', 'error', url, '2:/fr/' FROM g JOIN sites USING (site) WHERE kind = 5 AND r IN (3, 4) AND starts_with(path, '/fr/')
  UNION ALL SELECT site, 'robots.blocks-site', CASE WHEN claims THEN 'error' ELSE 'warning' END, site, '/' FROM sites JOIN said USING (site) WHERE kind = 4
  UNION ALL SELECT site, 'robotstxt.cross-origin', 'warning', site || '/robots.txt', 'https://elsewhere.example/robots.txt' FROM sites WHERE kind = 2
  UNION ALL SELECT site, 'robotstxt.invalid-line', 'warning', site, '1,4' FROM sites WHERE kind = 6
  UNION ALL SELECT site, 'robotstxt.oversized', 'error', site || '/robots.txt', '600000' FROM sites WHERE kind = 3
  UNION ALL SELECT site, 'robotstxt.sitemap.relative', 'error', site, '/rel.xml (1)' FROM sites WHERE kind = 5
  UNION ALL SELECT site, 'robotstxt.unknown-directive', 'info', site, 'crawl-delay host (2)' FROM sites WHERE kind = 5
  UNION ALL SELECT site, 'robotstxt.unreachable', 'error', site || '/robots.txt', CASE kind WHEN 0 THEN '0' ELSE '503' END FROM sites WHERE kind IN (0, 1)
  UNION ALL SELECT site, 'sitemap.empty', 'warning', site, '0' FROM sites WHERE other = 2
  UNION ALL SELECT site, 'sitemap.index.child-error', 'error', site, '2' FROM sites WHERE other = 3
  UNION ALL SELECT site, 'sitemap.limits.exceeded', 'error', site || '/sitemap.xml', '60000 1000' FROM sites WHERE other = 3
  UNION ALL SELECT site, 'sitemap.missing', 'warning', site, 'none' FROM sites WHERE other = 0
  UNION ALL SELECT site, 'sitemap.unparsable', 'error', site, 'no candidate parses' FROM sites WHERE other = 1
  UNION ALL {_sampled_rule("sitemap.entry.blocked-by-robots", "error", "url", "e JOIN sites USING (site) WHERE kind = 5 AND starts_with(path, '/fr/')")}
  UNION ALL {_sampled_rule("sitemap.entry.noindex", "warning", "url", "el WHERE lr IN (1, 2)")}
  UNION ALL {_sampled_rule("sitemap.entry.non-canonical", "warning", "url", "el WHERE lc IN (1, 2)")}
  UNION ALL {_sampled_rule("sitemap.entry.redirects", "warning", "url", "e WHERE split_part(path, '/', 2) = 'fr' AND path NOT LIKE '%.html'")}
  UNION ALL {_sampled_rule("sitemap.entry.unreachable", "error", "url", "e WHERE path LIKE '%.html'")}
)"""
#: Rules that have queries of their own above.
ELSEWHERE = ("sitemap.entry.cross-host", "sitemap.entry.out-of-scope", "sitemap.entry.protocol-mismatch", "sitemap.field.invalid", "sitemap.lastmod.invalid", "sitemap.orphans", "sitemap.entry.invalid-url")


@query("dressed_site_rules", f"{DRESSED_SITES} SELECT site, rule_id, severity, page_url, observed FROM found")
def dressed_site_rules(spark, sf_dir):
    rules = [r for r in site_rules.RULES if r.id not in ELSEWHERE]
    return site_rules.evaluate(dressed_site(spark, sf_dir), rules).drop("rigor")


@query("dressed_site_advisories", f"{DRESSED_SITES} SELECT site, url AS page_url, array_to_string(extra, ',') AS observed FROM gaps WHERE len(extra) > 0")
def dressed_site_advisories(spark, sf_dir):
    return site_rules.evaluate(dressed_site(spark, sf_dir), site_rules.ADVISORIES).select("site", "page_url", "observed")
