"""Clusters: against brute force, and families whose pairs nobody could write out."""

import random

import pytest
from pyspark.sql import functions as F

from loomaudit.operators import clusters

ALTERNATES = "array<struct<ord: int, hreflang: string, href: string, is_default: boolean>>"


def address(i):
    return f"https://a.example/{'en' if i % 2 else 'fr'}/{i}"


def drawn(seed, n=14):
    """Pages (visit_ord, own address, alternates (hreflang, href)); some share a list, some have an address twice."""
    dice = random.Random(seed)
    pools = [dice.sample(range(n), dice.randint(1, 6)) for _ in range(5)]
    defaults = [[], [dice.choice(pools[0])] if dice.random() < 0.8 else dice.sample(range(n), 2)]
    pages = []
    for i in range(n + 3):
        own = dice.randrange(n) if i >= n else i
        members = dice.choice(pools) if dice.random() < 0.8 else dice.sample(range(n), 3)
        pages.append((i, address(own), [("en", address(m)) for m in members] + [("x-default", address(m)) for m in dice.choice([*defaults, members[:1]])]))
    return pages


def heads_by_hand(pages):
    seen = {}
    for _, url, alternates in pages:
        if url not in seen:
            found = {h for tag, h in alternates if tag == "x-default"}
            seen[url] = ({h for tag, h in alternates if tag != "x-default" and h != url}, found.pop() if len(found) == 1 else None)
    rows, refused, left = {}, 0, set(seen)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            todo += [y for y in seen[x][0] if y in seen and x in seen[y][0] and y not in group]
        left -= group
        named = {seen[x][1] for x in group} - {None}
        if len(group) > 1:
            anchor = named.pop() if len(named) == 1 else None
            if anchor in group:
                rows |= dict.fromkeys(group, "/" + anchor.rpartition("/")[2])
            else:
                refused += 1
    return rows, refused


def sitemap_by_hand(pages):
    rows, disputed, refused = {}, set(), 0
    for _, url, alternates in pages:
        default = next((h for tag, h in alternates if tag == "x-default"), None)
        if not alternates or default is None:
            refused += bool(alternates)
            continue
        route = "/" + default.rpartition("/")[2]
        for x in [url, *(h for _, h in alternates)]:
            if rows.setdefault(x, route) != route:
                disputed.add(x)
    return rows, disputed, refused


@pytest.mark.parametrize("seed", range(4))
def test_clusters_by_hand(spark, seed):
    pages = drawn(seed)
    rows = [("https://a.example", u, i, [(n, t, h, t == "x-default") for n, (t, h) in enumerate(a)]) for i, u, a in pages]
    df = spark.createDataFrame(rows, f"site string, page_url string, visit_ord bigint, alternates {ALTERNATES}")
    found, refused = clusters.from_heads(df)
    assert ({r["key"]: r["route"] for r in found.collect()}, sum(r["clusters"] for r in refused.collect())) == heads_by_hand(pages)
    entries = df.select("site", F.col("visit_ord").alias("ord"), F.col("page_url").alias("loc"), F.transform("alternates", lambda a: F.struct(a["hreflang"].alias("hreflang"), a["href"].alias("href"))).alias("alternates"))
    found, disputed, refused = clusters.from_sitemap(entries)
    assert ({r["key"]: r["route"] for r in found.collect()}, {r["key"] for r in disputed.collect()}, sum(r["entries"] for r in refused.collect())) == sitemap_by_hand(pages)


def test_a_list_that_many_share_is_met_once(spark):
    """100,000 pages that all name each other: 10 billion pairs."""
    n = 100_000
    url = F.concat(F.lit("https://a.example/fr/"), F.col("id").cast("string"))
    lists = spark.range(n + 1).select(F.lit("all").alias("list"), F.col("id").alias("place"), F.when(F.col("id") == n, "x-default").otherwise("fr").alias("hreflang"), F.when(F.col("id") == n, "https://a.example/fr/7").otherwise(url).alias("href"), (F.col("id") == n).alias("is_default"))
    pages = spark.range(n).select(F.lit("https://a.example").alias("site"), url.alias("page_url"), F.col("id").alias("visit_ord"), F.lit("all").alias("list"))
    rows, refused = clusters.from_heads(pages, lists)
    assert rows.where("route = '/7'").count() == n and refused.isEmpty()
    rows, disputed, refused = clusters.from_sitemap(pages.select("site", F.col("visit_ord").alias("ord"), F.col("page_url").alias("loc"), "list"), lists)
    assert rows.where("route = '/7'").count() == n and disputed.isEmpty() and refused.isEmpty()
