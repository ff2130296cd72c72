"""Breadth-first crawls: over a snapshot, which of its pages a visitor reaches; live, by asking for each level.

Each level is a join of the frontier with the snapshot, or a round of requests;
what has been seen is a table, taken away by an anti join. Levels are few and
bounded by `depth`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U
from loomaudit.operators import extract
from loomaudit.operators.graph import cut, stored
from loomaudit.sources import snapshot


def candidates(raw: DataFrame) -> DataFrame:
    """(site, page_url, href, source, ord) of the links that a crawl may follow: alternates, next and previous, anchors; of a repeated target the most trusted source."""
    rel = lambda x: F.lower(F.coalesce(x["rel"], F.lit("")))
    links, anchors = F.col("raw.links"), F.col("raw.anchors")

    def found(items, source: str, rank: int):
        return F.transform(items, lambda x: F.struct(F.lit(rank).alias("rank"), x["ord"].alias("ord"), F.lit(source).alias("source"), x["url"].alias("href")))

    alternates = F.filter(links, lambda x: (rel(x) == "alternate") & (F.coalesce(x["hreflang"], F.lit("")) != ""))
    steps = F.filter(links, lambda x: rel(x).isin("next", "prev"))
    plain = F.filter(anchors, lambda x: x["tag"] == "a")
    each = raw.select("site", "page_url", F.explode(F.concat(found(alternates, "hreflang", 0), found(steps, "head-link", 1), found(plain, "body-anchor", 2))).alias("c"))
    return each.groupBy("site", "page_url", F.col("c.href").alias("href")).agg(F.min(F.struct("c.rank", "c.ord", "c.source")).alias("c")).select("site", "page_url", "href", "c.source", F.struct("c.rank", "c.ord").alias("ord"))


def followed(raw: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The candidates of raw pages, with `to`, that stay on their site and pass the filters; alternates need not pass them."""
    links = candidates(raw).withColumn("to", U.canonical_url(U.parsed(F.col("href")))).where("to is not null")
    path, origin = F.regexp_extract("to", "^[a-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract("to", "^[a-z]+://[^/?#]*", 0)
    return links.where((origin == F.col("site")) & (X.path_allowed(path, include or [], exclude or []) | (F.col("source") == "hreflang")))


def crawl(seeds: DataFrame, raw: DataFrame, answers: DataFrame, depth: int = 2, most_pages: int = 200, include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(visited, errors) from seeds (site, url), declared raw pages and answers (url, status, final_url).

    visited: (site, url, final_url, depth, place), one row for each final URL, the first way to it, at most most_pages a site; errors: (site, url) that did not answer. Links stay on their site and pass the filters; alternates need not."""
    links = followed(raw, include, exclude).select("site", F.col("page_url").alias("from"), "to")
    known = answers.select(F.col("url").alias("to"), "status", U.canonical_url(U.parsed(F.col("final_url"))).alias("final_url"))
    pages = raw.select("site", "page_url", U.canonical_url(U.parsed(F.col("page_url"))).alias("final_url"))
    frontier = seeds.select("site", U.canonical_url(U.parsed(F.col("url"))).alias("to")).where("to is not null").distinct()
    asked = cut(frontier.withColumn("depth", F.lit(0)))
    level = asked
    for n in range(1, depth + 1):
        here = level.join(known.where("status between 200 and 299"), "to").join(pages, ["site", "final_url"]).select("site", F.col("page_url").alias("from"))
        fresh = here.join(links, ["site", "from"]).select("site", "to").distinct().join(asked.select("site", "to"), ["site", "to"], "left_anti")
        level = cut(fresh.withColumn("depth", F.lit(n)))
        if level.isEmpty():
            break
        asked = cut(asked.unionByName(level))
    answered = asked.join(known, "to", "left")
    good = answered.where("status between 200 and 299 and final_url is not null")
    once = good.withColumn("n", F.row_number().over(Window.partitionBy("site", "final_url").orderBy("depth", "to"))).where("n = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("depth", "to"))).where(F.col("place") <= most_pages)
    visited = placed.select("site", F.col("to").alias("url"), "final_url", "depth", "place")
    return visited, answered.where("status is null or status = 0").select("site", F.col("to").alias("url"))


def _first(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("n = 1").drop("n")


def live(seeds: DataFrame, ask: Callable[[DataFrame], DataFrame], depth: int = 2, most_pages: int = 200, include: list[str] | None = None, exclude: list[str] | None = None) -> dict[str, DataFrame]:
    """A crawl from seeds (site, url, ord) that asks for what it meets; `ask` gives rows with requested_url their `answer`.

    fetches: every answer but those of status 0 (site, page_url, visit_ord, status, content_type, headers, html), a document that several requests end at once, its first; visited (site, url, final_url, depth, place); errors (site, url, reason) that did not answer; recovered (site, url) that answered on the second try; truncated (site) that most_pages cut short.

    A level is asked for in the order of the pages that link to it, in rounds: as many as may still be kept of a site, again where some of them were no new page. Only the last round's rows pass between rounds."""
    start = seeds.select("site", U.canonical_url(U.parsed(F.col("url"))).alias("to"), F.struct(F.lit(0).cast("bigint").alias("parent"), F.lit(0).alias("rank"), F.col("ord").cast("bigint").alias("ord")).alias("turn")).where("to is not null")
    level = cut(start.groupBy("site", "to").agg(F.min("turn").alias("turn")))
    asked, answers, kept = level.select("site", "to"), [], None
    for n in range(depth + 1):
        waiting, new = level, []
        while True:
            few = waiting.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("turn", "to"))).where(F.col("n") <= most_pages)
            if kept is not None:
                few = few.join(kept.groupBy("site").agg(F.count("*").alias("have")), "site", "left").where(F.col("n") + F.coalesce("have", F.lit(0)) <= most_pages).drop("have")
            batch = cut(few.select("site", F.col("to").alias("requested_url"), "turn"))
            if batch.isEmpty():
                break
            got = stored(ask(batch).withColumns({"depth": F.lit(n), "final_url": F.coalesce(U.canonical_url(U.parsed(F.col("answer.page_url"))), "answer.page_url")}), "crawl-answers")
            answers.append(got)
            pages = _first(got.where(snapshot.is_healthy(F.col("answer.status"))), ["site", "final_url"], "turn", "requested_url")
            if kept is not None:
                pages = pages.join(kept.select("site", "final_url"), ["site", "final_url"], "left_anti").join(kept.groupBy("site").agg(F.count("*").alias("have")), "site", "left")
            else:
                pages = pages.withColumn("have", F.lit(0))
            place = F.row_number().over(Window.partitionBy("site").orderBy("turn", "requested_url")) + F.coalesce("have", F.lit(0))
            fresh = stored(pages.withColumn("place", place.cast("bigint")).drop("have"), "crawl-pages")
            new.append(fresh)
            one = fresh.select("site", F.col("requested_url").alias("url"), "final_url", "depth", "place")
            kept = one if kept is None else cut(kept.unionByName(one))
            waiting = cut(waiting.join(batch.select("site", F.col("requested_url").alias("to")), ["site", "to"], "left_anti"))
        if n == depth or not new:
            break
        html = reduce(DataFrame.unionByName, new).where(snapshot.is_html(F.col("answer.content_type")) & F.col("answer.html").isNotNull())
        raw = extract.raw_pages(html.select("site", F.col("answer.page_url").alias("page_url"), F.col("place").alias("visit_ord"), F.col("answer.status").alias("status"), F.col("answer.content_type").alias("content_type"), F.col("answer.headers").alias("headers"), F.col("answer.html").alias("html")))
        places = html.select("site", F.col("answer.page_url").alias("page_url"), "place")
        found = followed(raw, include, exclude).join(places, ["site", "page_url"]).groupBy("site", "to").agg(F.min(F.struct(F.col("place").alias("parent"), F.col("ord.rank").alias("rank"), F.col("ord.ord").cast("bigint").alias("ord"))).alias("turn"))
        level = cut(found.join(asked, ["site", "to"], "left_anti"))
        if level.isEmpty():
            break
        asked = cut(asked.unionByName(level.select("site", "to")))
    if kept is None:
        none = level.select("site", F.col("to").alias("requested_url"), "turn", F.lit(0).alias("depth"), F.col("to").alias("final_url"))
        answers = [ask(none)]
        kept = none.select("site", F.col("requested_url").alias("url"), "final_url", "depth", F.lit(0).cast("bigint").alias("place"))
    every = reduce(DataFrame.unionByName, answers)
    answered = every.where("answer.status > 0").join(kept.select("site", F.col("url").alias("requested_url"), "place"), ["site", "requested_url"], "left")
    pages = answered.where(~snapshot.is_healthy(F.col("answer.status")) | F.col("place").isNotNull())
    fetches = pages.select("site", "answer.page_url", F.coalesce("place", F.lit(2**40)).alias("visit_ord"), "answer.status", "answer.content_type", F.coalesce("answer.headers", F.create_map().cast("map<string,string>")).alias("headers"), "answer.html")
    return {
        "fetches": fetches, "visited": kept, "errors": every.where("answer.status = 0").select("site", F.col("requested_url").alias("url"), "answer.reason"),
        "recovered": every.where("answer.status > 0 and answer.attempts > 1").select("site", F.col("requested_url").alias("url")),
        "truncated": kept.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") >= most_pages).select("site"),
    }
