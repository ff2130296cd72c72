"""Small reports as text. Only bounded aggregates come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.plans import page_rules, report, site_rules

MOST_ROWS = 20


def summary_text(summary: DataFrame, findings: DataFrame) -> str:
    """A line for each of the sites with most findings, then the rules that found most."""
    out = []
    for r in summary.orderBy(F.desc("findings"), "site").limit(MOST_ROWS).collect():
        out.append(f"{r['verdict'].upper():6} {r['site']}: {r['pages']} pages, {r['findings']} findings, {r['errors']} errors, {r['broken_links']} broken links")
    for r in report.rollup_by_rule(findings).limit(MOST_ROWS).collect():
        out.append(f"  {r['severity']:7} {r['rule_id']}: {r['findings']}, for example {r['pages'].split(' ')[0]}")
    return "\n".join(out)


def difference_text(changes: DataFrame, age_days: int | None = None) -> str:
    """Counts of added, resolved and kept findings, and the worst of the added and resolved."""
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    out = [", ".join(f"{counts.get(c, 0)} {c}" for c in ("added", "resolved", "kept")) + ("" if age_days is None else f"; the baseline is {age_days} days old")]
    for change in ("added", "resolved"):
        worst = changes.where(F.col("change") == change).orderBy(X.severity_rank(F.col("severity")), "kind", "summary", "id").limit(MOST_ROWS)
        out += [f"{'+' if change == 'added' else '-'} {r['severity']:7} {r['rule_id']} {r['page_url']}" for r in worst.collect()]
    return "\n".join(out)


def catalogue_json() -> str:
    """All rules with kind, severity, rigor and sources."""
    pages = [{"id": r.id, "scope": "page", "kind": r.kind, "severity": r.severity, "severities": r.severities, "rigor": r.rigor, "category": r.category, "sources": list(r.sources), "title": r.title} for r in page_rules.page_rules()]
    sites = [{"id": r.id, "scope": "site", "kind": "site", "severity": r.severity, "rigor": r.rigor, "needs": list(r.needs)} for r in site_rules.RULES]
    prose = [{"id": a.id, "scope": "page", "kind": "prose", "evidence": list(a.evidence)} for a in page_rules.advisories_of()] + [{"id": r.id, "scope": "site", "kind": "prose"} for r in site_rules.ADVISORIES]
    return json.dumps({"rules": pages + sites + prose}, indent=1)


def cited(rules: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(citations (rule_id, id, url), rules (rule_id, id) that cite what is not there, sources (id) that no rule cites) of a table of rules (rule_id, sources: joined by commas) and one of sources (id, url)."""
    each = rules.select("rule_id", F.explode(F.filter(F.split(F.coalesce("sources", F.lit("")), ","), lambda x: x != "")).alias("id")).distinct()
    return each.join(sources.select("id", "url"), "id").select("rule_id", "id", "url"), each.join(sources, "id", "left_anti").select("rule_id", "id"), sources.join(each, "id", "left_anti").select("id")


def source_faults(sources: DataFrame) -> DataFrame:
    """(id, fault) in a table of cited sources (id, url, consulted, quote): duplicate ids, URLs that are not https or have a fragment, impossible dates, long quotes."""
    twice = sources.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("fault"))
    tests = {"not https": ~F.col("url").startswith("https://"), "has a fragment": F.col("url").contains("#"), "no real date": F.expr("try_cast(consulted as date)").isNull(), "long quote": F.length("quote") > 300}
    faults = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items())))
    return twice.unionByName(sources.select("id", F.explode(faults).alias("fault")))


def preview_html(cards: DataFrame, most: int = 200) -> str:
    """Share cards as one HTML page, for at most so many cards; texts are escaped and clipped."""

    def shown(name: str, width: int):
        return F.coalesce(X.html_escaped(F.substring(name, 1, width)), F.lit("")).alias(name)

    rows = cards.orderBy("page_url", "surface").limit(most).select(shown("page_url", 300), "surface", shown("title", 200), shown("description", 400), shown("image", 500)).collect()
    body = "".join(f"<section><h2>{r['surface']}: {r['page_url']}</h2><h3>{r['title']}</h3><p>{r['description']}</p><p>{r['image']}</p></section>" for r in rows)
    return f"<!DOCTYPE html><meta charset=utf-8><title>Share cards</title>{body}"
