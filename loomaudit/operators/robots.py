"""robots.txt: lines, groups and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomaudit.functions import text as X

RULES = ("allow", "disallow")
#: Directives that some crawlers read and the standard does not name (fixed values).
EXTENSIONS = ("crawl-delay", "host", "clean-param", "noindex", "request-rate")


def lines(robots: DataFrame) -> DataFrame:
    """(site, line, raw, name, value, kind, group_no, reason) for each line that says something, from robots (site, body).

    kind is agent, allow, disallow, sitemap, unknown or invalid. Agents in a row share a group; one after a rule opens the next."""
    each = robots.select("site", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n")).alias("at", "raw"))
    said = X.trimmed(F.regexp_replace("raw", "#.*$", ""))
    colon = F.instr(F.col("said"), ":")
    split = each.withColumn("said", said).where("said <> ''").select(
        "site",
        (F.col("at") + 1).alias("line"),
        "raw",
        F.when(colon > 0, F.lower(X.trimmed(F.substr("said", F.lit(1), colon - 1)))).alias("name"),
        F.when(colon > 0, X.trimmed(F.substr("said", colon + 1))).alias("value"),
    )
    kind = (
        F.when(F.col("name") == "user-agent", F.when(F.col("value") == "", "invalid").otherwise("agent"))
        .when(F.col("name") == "sitemap", F.when(F.col("value") == "", "invalid").otherwise("sitemap"))
        .when(F.col("name").isin(*RULES), F.col("name"))
        .when(F.col("name").isin(*EXTENSIONS), "unknown")
        .otherwise("invalid")
    )
    kinds = split.withColumn("kind", kind)
    in_order = Window.partitionBy("site").orderBy("line")
    turns = F.when(F.col("kind").isin("agent", *RULES), F.col("kind"))
    before = F.last(turns, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = ((F.col("kind") == "agent") & (before.isNull() | (before != "agent"))).cast("int")
    grouped = kinds.withColumn("opens", opens).withColumn("group_no", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")
    stray = F.col("kind").isin(*RULES) & (F.col("group_no") == 0)
    reason = F.when(stray, "rule before any group").when(F.col("kind") != "invalid", None).when(F.col("name").isNull(), "no separator").when(F.col("name").isin("user-agent", "sitemap"), "empty value").otherwise("unknown directive")
    return grouped.withColumn("reason", reason).withColumn("kind", F.when(stray, "invalid").otherwise(F.col("kind")))


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a rule's pattern: * spans anything, $ at its end anchors, all else is literal; percent-decoded."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    literal = F.transform(F.split(body, r"\*"), lambda p: F.regexp_replace(X.octets_decoded(p), r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    return F.concat(F.lit("^"), F.array_join(literal, ".*"), F.when(anchored, "$").otherwise(""))


def governing_groups(said: DataFrame, agent: str = "*") -> DataFrame:
    """(site, group_no, token) of the groups for an agent: those of the longest token that its name starts with, else of *."""
    wanted = F.lit(agent.strip().lower())
    tokens = said.where("kind = 'agent'").select("site", "group_no", F.lower("value").alias("token"))
    named = tokens.where((F.col("token") != "*") & F.startswith(wanted, F.col("token")))
    best = named.groupBy("site").agg(F.max_by("token", F.length("token")).alias("best"))
    chosen = tokens.join(best, "site", "left").where(F.col("token") == F.coalesce("best", F.lit("*")))
    return chosen.select("site", "group_no", "token").distinct()


def decisions(paths: DataFrame, said: DataFrame, agent: str = "*") -> DataFrame:
    """paths (site, path: with its query) with allowed, and the rule that decided (rule, line, token; null where none did). The longest pattern wins, allow among equals.

    The rules of a site, no more than a robots file holds, meet each of its paths as one array."""
    rules = said.where(F.col("kind").isin(*RULES) & (F.col("value") != "")).join(governing_groups(said, agent), ["site", "group_no"])
    allows = F.col("kind") == "allow"
    rule = F.struct(
        F.octet_length(X.octets_decoded(F.col("value"))).alias("octets"), allows.alias("allows"), F.when(allows, F.col("line")).otherwise(-F.col("line")).alias("place"),
        F.col("value").alias("rule"), F.col("line").alias("line"), F.col("token").alias("token"), pattern_regex(F.col("value")).alias("regex"),
    )
    of_site = rules.select("site", rule.alias("r")).groupBy("site").agg(F.collect_list("r").alias("_rules"))
    decoded = X.octets_decoded(F.col("path"))
    best = F.array_max(F.filter("_rules", lambda r: F.regexp_like(decoded, r["regex"])))
    out = paths.join(of_site, "site", "left").withColumn("_best", best)
    return out.select(*paths.columns, F.coalesce("_best.allows", F.lit(True)).alias("allowed"), F.col("_best.rule").alias("rule"), F.col("_best.line").alias("line"), F.col("_best.token").alias("token"))
