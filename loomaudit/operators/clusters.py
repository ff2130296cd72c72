"""Clusters of translated pages, declared in sitemaps or in page heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U
from loomaudit.operators.graph import components, stored


def shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (..., alternates) with `list`, the id of their alternates, in their place; lists (list, place, then the fields of an alternate): each list of alternates once. Null for rows without any."""
    named = rows.withColumn("list", F.when(F.size("alternates") > 0, F.sha2(F.to_json("alternates"), 256)))
    lists = named.where("list is not null").select("list", "alternates").dropDuplicates(["list"]).select("list", F.posexplode("alternates").alias("place", "a"))
    return named.drop("alternates"), lists.select("list", F.col("place").cast("bigint").alias("place"), "a.*")


def from_sitemap(entries: DataFrame, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (site, key, route), conflicts (site, key), refused (site, entries)) from entries (site, ord, loc, alternates); or with `list` for alternates and lists (list, place from 0, hreflang, href), so that entries which share a list need not repeat it.

    An entry's URLs take the route of its x-default. The first entry that names a URL keeps it; a later one with another route is a conflict. Entries with alternates but without a sound x-default are refused. What a list claims is what its first entry of a site claims by it, so a list is met once, not once for each entry."""
    if lists is None:
        entries, lists = shared(entries)
    default = F.min_by("href", F.when(F.lower(F.trim("hreflang")) == "x-default", F.col("place")))
    named = lists.groupBy("list").agg(default.alias("default")).withColumn("anchor", U.parsed(F.col("default")))
    path = F.when(F.length("anchor.path") > 1, F.regexp_replace("anchor.path", "/+$", "")).otherwise(F.col("anchor.path"))
    routes = named.select("list", F.when(F.col("anchor").isNotNull(), U.split_route(path)["route"]).alias("route"))
    anchored = entries.select("site", "ord", "loc", "list").join(routes, "list")
    sound = anchored.where("route is not null")
    own = sound.select("site", "ord", F.lit(-1).cast("bigint").alias("place"), "route", F.col("loc").alias("url"))
    heads = sound.groupBy("site", "list").agg(F.min("ord").alias("ord"), F.min("route").alias("route"))
    others = heads.join(lists.select("list", "place", F.col("href").alias("url")), "list").select("site", "ord", "place", "route", "url")
    claims = own.unionByName(others).withColumn("key", U.same_page_key(U.parsed(F.col("url")))).where("key is not null")
    kept = claims.groupBy("site", "key").agg(F.min_by("route", F.struct("ord", "place")).alias("route"), (F.min("route") != F.max("route")).alias("disputed"))
    refused = anchored.where("route is null").groupBy("site").agg(F.count("*").alias("entries"))
    return kept.select("site", "key", "route"), kept.where("disputed").select("site", "key"), refused


def _linked(first: DataFrame, lists: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of the pages (self, list) that name each other in their lists (list, key).

    Pages of one list that stand in it name each other; of two lists, all pages of the one that stand in the other do, if there are such pages both ways. Each such group is a star around its first page, so there are no more edges than entries of lists."""
    of = first.where("list is not null").select("self", F.col("list").alias("own"))
    reach = of.join(lists.select(F.col("key").alias("self"), F.col("list").alias("other")).distinct(), "self")
    pairs = stored(reach.select("self", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("up"), (F.col("own") >= F.col("other")).alias("down")), "list-pairs")
    hubs = pairs.groupBy("low", "high").agg(F.min("self").alias("hub"), F.bool_or("up").alias("up"), F.bool_or("down").alias("down")).where("up and down")
    return pairs.select("low", "high", "self").join(hubs.select("low", "high", "hub"), ["low", "high"]).where("self <> hub").select(F.col("hub").alias("a"), F.col("self").alias("b"))


def from_heads(pages: DataFrame, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows (site, key, route), refused (site, clusters)) from declared pages (site, page_url, visit_ord, alternates), or with `list` and lists (list, place, hreflang, href, is_default) as in `from_sitemap`: pages that point to each other form components; one that names a single x-default, itself a member, takes its route."""
    if lists is None:
        pages, lists = shared(pages.select("site", "page_url", "visit_ord", "alternates"))
    own = U.same_page_key(U.parsed(F.col("page_url")))
    visits = pages.select("site", "list", "visit_ord", own.alias("self")).where("self is not null")
    first = stored(visits.groupBy("self").agg(F.min_by(F.struct("site", "list"), "visit_ord").alias("f")).select("self", "f.*"), "first-visits")
    locale = F.when(F.col("is_default"), "x-default").otherwise(F.lower(X.trimmed(F.col("hreflang"))))
    keyed = stored(lists.select("list", locale.alias("locale"), U.same_page_key(U.parsed(F.col("href"))).alias("key")).where("key is not null"), "keyed-lists")
    named = components(_linked(first, keyed.where("locale <> 'x-default'")))
    defaults = keyed.where("locale = 'x-default'").groupBy("list").agg(F.min("key").alias("default"), F.max("key").alias("last")).where("default = last").select("list", "default")
    members = stored(named.join(first.withColumnRenamed("self", "node"), "node").join(defaults, "list", "left").select("root", "node", "site", "default"), "cluster-members")
    votes = members.groupBy("root").agg(F.min("default").alias("anchor"), F.max("default").alias("last"))
    seated = votes.join(members.select("root", F.col("node").alias("anchor"), F.lit(True).alias("member")), ["root", "anchor"], "left")
    route = U.split_route(U.parsed(F.col("anchor"))["path"])["route"]
    good = F.coalesce(F.col("member") & (F.col("anchor") == F.col("last")), F.lit(False))
    judged = seated.select("root", good.alias("good"), route.alias("route"))
    told = members.select("root", "node", "site").join(judged, "root")
    refused = told.where("not good").groupBy("site").agg(F.count_distinct("root").alias("clusters"))
    return told.where("good").select("site", F.col("node").alias("key"), "route"), refused


def combine(primary: DataFrame, secondary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts) of two indexes (site, key, route): the first decides, disagreement is a conflict."""
    both = primary.join(secondary.withColumnRenamed("route", "other"), ["site", "key"], "full_outer")
    return both.select("site", "key", F.coalesce("route", "other").alias("route")), both.where("route <> other").select("site", "key")


def only_from(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(site, clusters) that only the second index supplies."""
    return secondary.join(primary, ["site", "key"], "left_anti").groupBy("site").agg(F.count_distinct("route").alias("clusters"))
