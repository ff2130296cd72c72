"""Findings with stable ids, their summary and verdict, and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U

CRASH_RULE = "engine.rule-crashed"
FINDINGS = ("id", "kind", "rule_id", "severity", "page_url", "summary")
SAMPLE = 5


def _route(url: str):
    return U.route_key(U.parsed(F.col(url)), F.col(url))


def page_findings(verdicts: DataFrame) -> DataFrame:
    """(FINDINGS, site, rigor, occurrence) of the page rules that found something; the n-th finding of a rule on a page has its own id. A rule that crashed is a finding of its own, for information."""
    crashed = F.col("status") == "crashed"
    found = verdicts.where("severity is not null").withColumns(
        {"observed": F.when(crashed, F.concat(F.lit("rule "), F.col("rule_id"), F.lit(": "), F.coalesce("observed", F.lit("")))).otherwise(F.col("observed")), "rule_id": F.when(crashed, CRASH_RULE).otherwise(F.col("rule_id"))}
    )
    nth = F.row_number().over(Window.partitionBy("site", "rule_id", "page_url").orderBy("visit_ord", "ord")) - 1
    numbered = found.withColumns({"occurrence": nth, "route_key": _route("page_url")})
    return numbered.select(X.identity("seo", F.col("rule_id"), F.col("route_key"), F.col("occurrence").cast("string")).alias("id"), F.lit("seo").alias("kind"), "rule_id", "severity", "page_url", F.col("observed").alias("summary"), "site", "rigor", "occurrence")


def site_findings(found: DataFrame) -> DataFrame:
    """The same of site rules."""
    nth = F.row_number().over(Window.partitionBy("site", "rule_id", "page_url").orderBy("observed")) - 1
    numbered = found.withColumns({"occurrence": nth, "route_key": _route("page_url")})
    return numbered.select(X.identity("site", F.col("rule_id"), F.col("route_key"), F.col("occurrence").cast("string")).alias("id"), F.lit("site").alias("kind"), "rule_id", "severity", "page_url", F.col("observed").alias("summary"), "site", "rigor", "occurrence")


def link_findings(broken: DataFrame) -> DataFrame:
    """FINDINGS of links that do not answer well."""
    target = U.target_key(U.parsed(F.col("url")), F.col("url"))
    return broken.select(X.identity("link", _route("page_url"), target).alias("id"), F.lit("link").alias("kind"), F.col("verdict").alias("rule_id"), F.when(F.col("verdict") == "broken", "error").otherwise("warning").alias("severity"), "page_url", F.col("url").alias("summary"))


def unreachable_findings(fetched: DataFrame) -> DataFrame:
    """FINDINGS of pages that did not answer."""
    dead = fetched.where("status not between 200 and 299")
    return dead.select(X.identity("page", _route("page_url")).alias("id"), F.lit("page").alias("kind"), F.lit("page.unreachable").alias("rule_id"), F.lit("error").alias("severity"), "page_url", F.col("status").cast("string").alias("summary"))


def translation_findings(holes: DataFrame, back_links: DataFrame) -> DataFrame:
    """FINDINGS of missing translations and of alternates that do not link back."""
    a = holes.select("id", F.lit("i18n").alias("kind"), F.lit("hole").alias("rule_id"), F.lit("warning").alias("severity"), F.concat("site", "route").alias("page_url"), F.col("missing").alias("summary"))
    b = back_links.select("id", F.lit("i18n").alias("kind"), F.col("code").alias("rule_id"), F.lit("warning").alias("severity"), F.col("url").alias("page_url"), F.coalesce("peer_url", "locale", F.lit("")).alias("summary"))
    return a.unionByName(b)


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (p.select(*FINDINGS) for p in parts))


def without_canonical_duplicates(pages: DataFrame) -> DataFrame:
    """Declared pages without those whose canonical URL is another page of the crawl."""
    keyed = pages.withColumns({"_own": _route("page_url"), "_canonical": F.when(F.col("canonical").isNotNull(), _route("canonical"))})
    crawled = keyed.select("site", F.col("_own").alias("_canonical")).distinct()
    copies = keyed.where("_canonical <> _own").join(crawled, ["site", "_canonical"], "left_semi").select("site", "page_url").distinct()
    return pages.join(copies, ["site", "page_url"], "left_anti")


def conformance(verdicts: DataFrame) -> DataFrame:
    """(rule_id, passed, failed, warned, not_applicable, crashed, pages) for each rule."""
    status = F.col("status")
    return verdicts.groupBy("rule_id").agg(*(F.count_if(status == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("warn", "warned"), ("na", "not_applicable"), ("crashed", "crashed"))), F.count("*").alias("pages"))


def rollup_by_rule(findings: DataFrame) -> DataFrame:
    """(rule_id, severity, findings, first: what the first page's finding says, pages: a sorted sample joined, more) worst first."""
    by_rule = findings.groupBy("rule_id").agg(F.min_by("severity", X.severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("findings"), F.min_by("summary", F.struct("page_url", "id")).alias("first"))
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy("page_url", "id"))
    sample = findings.withColumn("n", place).where(F.col("n") <= SAMPLE).groupBy("rule_id").agg(F.array_join(F.sort_array(F.collect_list("page_url")), " ").alias("pages"))
    out = by_rule.join(sample, "rule_id").select("rule_id", "severity", "findings", "first", "pages", F.greatest(F.col("findings") - SAMPLE, F.lit(0)).alias("more"))
    return out.orderBy(X.severity_rank(F.col("severity")), "rule_id")


def rollup_links(broken: DataFrame) -> DataFrame:
    """(url, verdict, pages, sample, more) most used first. Only SAMPLE pages of a link leave the tasks that count it."""
    counts = broken.groupBy("url", "verdict").agg(F.count("*").alias("pages"))
    place = F.row_number().over(Window.partitionBy("url", "verdict").orderBy("page_url"))
    sample = broken.select("url", "verdict", "page_url").withColumn("n", place).where(F.col("n") <= SAMPLE).groupBy("url", "verdict").agg(F.array_join(F.sort_array(F.collect_list("page_url")), " ").alias("sample"))
    grouped = counts.join(sample, ["url", "verdict"], "left").withColumn("sample", F.coalesce("sample", F.lit("")))
    return grouped.withColumn("more", F.greatest(F.col("pages") - SAMPLE, F.lit(0))).orderBy(F.desc("pages"), "url")


def rollup_reciprocity(back_links: DataFrame) -> DataFrame:
    return back_links.groupBy("code").agg(F.count("*").alias("findings"), F.min("url").alias("first_page")).orderBy(F.desc("findings"), "code")


def summary(sites: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each of sites (site): counts and the verdict. pages: those that answered (site); findings: FINDINGS with site.

    Red: no page answered, a link is broken, a page is unreachable, or any error. Yellow: any other finding."""
    counts = findings.groupBy("site").agg(
        F.count_distinct(F.when((F.col("kind") == "link") & (F.col("rule_id") == "broken"), F.col("summary"))).alias("broken_links"),
        F.count_if(F.col("kind") == "i18n").alias("missing_translations"),
        F.count_if(F.col("kind") == "seo").alias("page_issues"),
        F.count_if(F.col("kind") == "site").alias("site_issues"),
        F.count_if(F.col("kind") == "page").alias("unreachable_pages"),
        F.count_if((F.col("severity") == "error") & F.col("kind").isin("seo", "site")).alias("errors"),
        F.count("*").alias("findings"),
    )
    seen = pages.groupBy("site").agg(F.count("*").alias("pages"))
    names = ("pages", "broken_links", "missing_translations", "page_issues", "site_issues", "unreachable_pages", "errors", "findings")
    all_counts = sites.select("site").distinct().join(seen, "site", "left").join(counts, "site", "left").select("site", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    red = (F.col("pages") == 0) | (F.col("broken_links") > 0) | (F.col("unreachable_pages") > 0) | (F.col("errors") > 0)
    return all_counts.withColumn("verdict", F.when(red, "red").when(F.col("findings") > 0, "yellow").otherwise("green"))


def exit_code(verdict, fail_on: str = "error", fatal: Column | None = None):
    """0 or 1 for a verdict column: never fails, fails on red, or on any finding; 2 where the run could not ask its question (`fatal`), whatever it found."""
    if fatal is not None:
        return F.when(F.coalesce(fatal, F.lit(False)), 2).otherwise(exit_code(verdict, fail_on))
    if fail_on == "never":
        return F.lit(0)
    return F.when((verdict == "red") | ((verdict == "yellow") & F.lit(fail_on != "error")), 1).otherwise(0)


def difference(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """FINDINGS with change: added, resolved or kept. An id counts once; of findings that share one, the least counts, and what both runs hold is shown as it is now."""
    finding = F.struct(*FINDINGS)
    sides = baseline.select("id", F.lit(0).alias("now"), finding.alias("f")).unionByName(current.select("id", F.lit(1).alias("now"), finding.alias("f")))
    both = sides.groupBy("id").agg(F.min(F.when(F.col("now") == 0, F.col("f"))).alias("before"), F.min(F.when(F.col("now") == 1, F.col("f"))).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "resolved").otherwise("kept")
    return both.select(F.coalesce("after", "before").alias("f"), change.alias("change")).select("f.*", "change")


def gate(changes: DataFrame, fail_on: str = "error") -> DataFrame:
    """(added, resolved, kept, exit_code): fails on added findings at or above the threshold."""
    level = {"error": 0, "warning": 1}.get(fail_on, -1)
    blocking = F.count_if((F.col("change") == "added") & (X.severity_rank(F.col("severity")) <= level))
    return changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "resolved", "kept")), F.when(blocking > 0, 1).otherwise(0).alias("exit_code"))


HEAD_RULES = ("title.", "description.", "canonical.", "viewport.", "og.", "icons.", "robots.")


def head_findings(findings: DataFrame) -> DataFrame:
    """(page_url, head, others): findings about a page's head, and the count of the rest."""
    about_head = F.col("rule_id").rlike("^(" + "|".join(p.replace(".", "[.]") for p in HEAD_RULES) + ")")
    return findings.groupBy("page_url").agg(F.count_if(about_head).alias("head"), F.count_if(~about_head).alias("others"))


def write_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines: a report, or the baseline of a later run."""
    findings.select(*FINDINGS).write.mode("overwrite").json(path)


SEVERITIES = ("error", "warning", "info")


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, findings) with all severities present."""
    every = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(findings.groupBy("severity").agg(F.count("*").alias("findings")), "severity", "left").select("severity", F.coalesce("findings", F.lit(0)).alias("findings"))


def fatal_sites(diagnostics: DataFrame) -> DataFrame:
    """(site, reason) where a sitemap was named but did not answer: what was crawled instead is another site, and its findings are not comparable."""
    return diagnostics.where("unreachable and not found").select("site", F.lit("the sitemap could not be fetched").alias("reason"))


def scan_warnings(targets: DataFrame) -> DataFrame:
    """(site, targets, failed, warning) from targets (site, scanned: whether its links were read): blind where no page was scanned, partial where at least half were not."""
    counts = targets.groupBy("site").agg(F.count("*").alias("targets"), F.count_if(~F.coalesce("scanned", F.lit(False))).alias("failed"))
    warning = F.when(F.col("failed") == F.col("targets"), "blind").when((F.col("failed") > 0) & (2 * F.col("failed") >= F.col("targets")), "partial")
    return counts.withColumn("warning", warning).where("warning is not null")


def blocked_escalations(pages: DataFrame) -> DataFrame:
    """(site, pages, reason: of the first) of pages (site, visit_ord, escalation_blocked) that looked client-rendered and could only be judged as they were sent."""
    return pages.where("escalation_blocked is not null").groupBy("site").agg(F.count("*").alias("pages"), F.min_by("escalation_blocked", "visit_ord").alias("reason"))


def findings_by_page(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """pages (page_url) with each of their findings; a page without one has a row of nulls."""
    return pages.select("page_url").join(findings.select(*FINDINGS), "page_url", "left")


def siblings(pages: DataFrame) -> DataFrame:
    """(page_url, sibling, locale): the pages of a site (site, page_url, path) that show the same route in other locales."""
    at = U.split_route(F.col("path"))
    placed = pages.select("site", "page_url", at["route"].alias("route"), at["locale"].alias("locale"))
    others = placed.select("site", "route", F.col("page_url").alias("sibling"), F.col("locale").alias("other"))
    return placed.join(others, ["site", "route"]).where("locale <> other").select("page_url", "sibling", F.col("other").alias("locale"))


def origin_key(kind: Column, property: Column, http_equiv: Column, name: Column, rel: Column, attribute: Column, index: Column, path: Column) -> Column:
    """A stable key for where a declaration stands: title, a meta, a link, the html element, structured data, a header, or computed."""

    def said(x: Column) -> Column:
        return F.coalesce(x, F.lit("")) != ""

    meta = F.when(said(property), F.concat(F.lit("property:"), property)).when(said(http_equiv), F.concat(F.lit("http-equiv:"), http_equiv)).when(said(name), F.concat(F.lit("name:"), name)).otherwise("unknown")
    return (
        F.when(kind == "meta", F.concat(F.lit("meta:"), meta)).when(kind == "link", F.concat(F.lit("link:rel:"), rel)).when(kind == "html", F.concat(F.lit("html:"), attribute))
        .when(kind == "json-ld", F.concat_ws(":", F.lit("json-ld"), index.cast("string"), path)).when(kind == "header", F.concat(F.lit("header:"), F.lower(name))).otherwise(kind)
    )


def asset_failure(status: Column, content_type: Column) -> Column:
    """What went wrong with an asset."""
    code = F.concat(F.lit("HTTP "), status.cast("string"))
    return F.when(status == 0, "the request failed").when((status >= 400) | (status < 200), code).otherwise(F.concat(code, F.lit(" with "), F.coalesce(content_type, F.lit("no content type")), F.lit(", not an image")))


def pages_by_broken(broken: DataFrame) -> DataFrame:
    """(page_url, broken) of broken links (page_url, url), most first."""
    return broken.groupBy("page_url").agg(F.count_distinct("url").alias("broken")).orderBy(F.desc("broken"), "page_url")
