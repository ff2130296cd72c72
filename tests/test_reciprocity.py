"""Missing links back: against brute force, and a list that many pages share."""

import random

import pytest
from pyspark.sql import functions as F

from loomaudit.operators import locales

SITE = "https://a.example"
ALTERNATES = "array<struct<ord: int, hreflang: string, href: string, is_default: boolean>>"


def drawn(seed, n=12):
    """Pages (address, alternates (hreflang, href)); some share a list, some have an address twice, with different lists."""
    dice = random.Random(seed)
    address = lambda i: f"{SITE}/{i}"
    pools = [[(dice.choice(["en", "EN", "fr", "qq"]), address(dice.randrange(n + 2))) for _ in range(5)] for _ in range(4)] + [[]]
    return [(address(i if i < n else dice.randrange(n)), [*dice.choice(pools), *([("x-default", address(dice.randrange(n)))] if dice.random() < 0.3 else []), *([("de", address(i))] if dice.random() < 0.3 else [])]) for i in range(n + 4)]


def by_hand(pages):
    out, links = set(), {(u, h) for u, a in pages for _, h in a}
    seen = {u for u, _ in pages}
    for url in seen:
        told = [(t, h) for u, a in pages if u == url for t, h in a]
        out |= {("locale.invalid", url, t, None) for t, _ in told if t == "qq"}
        out |= {("missing-back-link", url, t.lower(), h) for t, h in told if t != "qq" and h in seen and (h, url) not in links}
        tags = {t.lower() for t, _ in told}
        if len(tags - {"x-default"}) >= 2 and "x-default" not in tags:
            out.add(("x-default-missing", url, None, None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_reciprocity_by_hand(spark, seed):
    pages = drawn(seed)
    df = spark.createDataFrame([(SITE, u, [(n, t, h, t == "x-default") for n, (t, h) in enumerate(a)]) for u, a in pages], f"site string, page_url string, alternates {ALTERNATES}")
    # The same with each alternate as a list of its own, of which a page carries many.
    each = df.select("site", "page_url", F.explode_outer("alternates").alias("a")).withColumn("list", F.when(F.col("a").isNotNull(), F.concat_ws(" ", "a.hreflang", "a.href")))
    several = each.select("site", "page_url", "list"), each.where("list is not null").select("list", "a.hreflang", "a.href", "a.is_default").distinct()
    for found in (locales.reciprocity(df).collect(), locales.reciprocity(*several).collect()):
        rows = [(r["code"], r["url"], r["locale"], r["peer_url"]) for r in found]
        assert len(rows) == len(set(rows)) and set(rows) == by_hand(pages) and len({r["id"] for r in found}) == len(rows)


def test_a_list_that_many_share_is_judged_once(spark):
    """40,000 pages name 40,000 others, of which the last 3 do not link back: 120,000 rows out of 1.6 billion pairs."""
    n = 40_000
    url = F.concat(F.lit(f"{SITE}/"), F.col("id").cast("string"))
    lists = spark.range(n).select(F.lit("all").alias("list"), F.lit("fr").alias("hreflang"), url.alias("href"), F.lit(False).alias("is_default"))
    pages = spark.range(n).select(F.lit(SITE).alias("site"), url.alias("page_url"), F.when(F.col("id") < n - 3, "all").alias("list"))
    found = locales.reciprocity(pages, lists)
    assert found.count() == found.distinct().count() == 3 * (n - 3)
