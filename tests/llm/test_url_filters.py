import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomaudit.llm import url_filters
from loomaudit.llm.url_filters import Rule


@pytest.mark.parametrize(
    ("host", "domain", "suffix"),
    [
        ("a.b.co.uk", "b.co.uk", "co.uk"),
        ("b.co.uk", "b.co.uk", "co.uk"),
        ("a.b.com:8080", "b.com", "com"),
        ("10.0.0.7:80", "10.0.0.7", "10.0.0.7"),
        ("[::1]:80", "[::1]", "[::1]"),
        ("localhost", "localhost", "localhost"),
        ("", "", ""),
        ("x.y.com.mx", "y.com.mx", "com.mx"),
    ],
)
def test_domains(spark, host, domain, suffix):
    h = F.lit(host)
    assert tuple(spark.range(1).select(url_filters.domain_of(h), url_filters.suffix_of(h)).first()) == (domain, suffix)


def test_a_callers_suffixes(spark):
    assert spark.range(1).select(url_filters.domain_of(F.lit("a.me.github.io"), ("github.io",))).first()[0] == "me.github.io"


def brute_bounds(outcomes, hosts, of):
    """host -> bound, by the definition, from [(host, bad)]; of(host) is (domain, suffix)."""

    def level(groups, above):
        s = v = w = 0.0
        for g, (n, bad) in groups.items():
            if n:
                m = above[g]
                s, v, w = s + n * (bad / n - m) ** 2, v + m * (1 - m), w + m * (1 - m) * (n - 1)
        rho = min(0.5, max(0.001, (s - v) / w)) if w > 0 else 0.001
        strength = (1 - rho) / rho
        return {g: (bad + strength * above[g]) / (n + strength) for g, (n, bad) in groups.items()}, strength

    def sums(name):
        out = defaultdict(lambda: [0, 0])
        for h in hosts:
            out[name(h)]
        for h, bad in outcomes:
            out[name(h)][0] += 1
            out[name(h)][1] += bad
        return out

    mean = sum(b for _, b in outcomes) / len(outcomes)
    suffixes = sums(lambda h: of(h)[1])
    suffix_rate, _ = level(suffixes, dict.fromkeys(suffixes, mean))
    domains = sums(lambda h: of(h)[0])
    parents = {of(h)[0]: suffix_rate[of(h)[1]] for h in [*hosts, *(h for h, _ in outcomes)]}
    domain_rate, _ = level(domains, parents)
    by_host = sums(lambda h: h)
    rates, strength = level(by_host, {h: domain_rate[of(h)[0]] for h in by_host})
    return {h: r - url_filters.BOUND_Z * math.sqrt(r * (1 - r) / (by_host[h][0] + strength + 1)) for h, r in rates.items()}


def sites():
    """Domains of different rates, whose hosts agree with their domain."""
    rng = random.Random(3)
    outcomes = []
    for d in range(12):
        rate = 0.97 if d < 3 else 0.05
        for h in range(4):
            host = f"h{h}.d{d}.{'com' if d % 2 else 'co.uk'}"
            outcomes += [(host, int(rng.random() < rate)) for _ in range(2 if h == 0 else 40)]
    return outcomes


def test_bounds_equal_brute_force_and_bad_domains_are_blocked(spark):
    outcomes = sites()
    hosts = sorted({h for h, _ in outcomes}) + ["h9.d0.co.uk", "h9.d5.com", "other.org"]
    of = lambda h: (".".join(h.split(".")[1:]) if h.count(".") > 1 else h, "co.uk" if h.endswith("co.uk") else h.rpartition(".")[2])
    expected = brute_bounds(outcomes, hosts, of)
    table = spark.createDataFrame(outcomes, "host string, bad int")
    got = {r["host"]: r["bound"] for r in url_filters.reputation(spark.createDataFrame([(h,) for h in hosts], "host string"), table).collect()}
    assert set(got) == set(expected)
    assert all(got[h] == pytest.approx(b, rel=1e-9) for h, b in expected.items())
    urls = spark.createDataFrame([(i, f"https://{h}/x") for i, h in enumerate(hosts)], "page_id bigint, url string")
    verdicts = {r["host"]: r["verdict"] for r in url_filters.judged(urls, table, []).collect()}
    # A host of two outcomes, and one of none, go by their domain.
    assert all(verdicts[h] == ("block" if of(h)[0] in ("d0.co.uk", "d1.com", "d2.co.uk") else "allow") for h in hosts)


def test_repeated_rows_ties_long_urls_and_empty_tables(spark):
    none = spark.createDataFrame([], "host string, bad int")
    long = "https://a.net/" + "x" * 300_000
    urls = spark.createDataFrame([(1, "https://a.net/p", "k"), (1, "https://a.net/p", "k"), (None, None, "k"), (2, long, "k")], "page_id bigint, url string, host string")
    rules = [Rule("a.net", "/", "allow"), Rule("a.net", "/", "block")]
    got = sorted((r["page_id"] or 0, len(r["path"]), r["verdict"]) for r in url_filters.judged(urls, none, rules).collect())
    assert got == [(0, 0, "allow"), (1, 2, "block"), (1, 2, "block"), (2, 300_001, "block")]
    assert url_filters.judged(urls.limit(0), none, rules).count() == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    table = spark.createDataFrame(sites(), "host string, bad int")
    urls = table.distinct().select(F.xxhash64("host", "bad").alias("page_id"), F.concat(F.lit("https://"), "host").alias("url"))
    broadcast = sorted(map(tuple, url_filters.judged(urls, table, []).collect()))
    monkeypatch.setattr(url_filters, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, url_filters.judged(urls, table, []).collect())) == broadcast
