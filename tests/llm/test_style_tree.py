import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomaudit.llm import html_text, queries
from loomaudit.llm.common import load
from loomaudit.llm.url_filters import domain_of, host_of

SCHEMA = "page_id bigint, url string, html string"


@pytest.fixture
def larger(data):
    """Tables in which some hosts have pages enough for a tree of their own."""
    return data.replace("sf0.001", "sf0.01")


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p data-x=it's>Don't stop</p><p>end</p>", "Don't stop\nend"),
        ('<p title="a > b" "stray>one</p><p>two</p>', "one\ntwo"),
        ("<p title = 'class=ad'>one</p>", "one"),
        ("<div class='content-sidebar-wrap'><main>Body text</main></div>", "Body text"),
        ("<div class='post no-sidebar'><p>Body</p></div>", "Body"),
        ("<article class='comment-free'>a</article>", "a"),
        ('<div class="main" role="navigation">n</div><p>x', "x"),
        ('<div role="main">n</div><p>x', "n\nx"),
        ("<article>a<div class=ad>b</div><section class=comments><article>c</article></section></article>", "a"),
        ("<div><article>a</article><footer><p>f</p></footer></div>", "a"),
    ],
)
def test_no_text_is_lost_to_markup(html, text):
    blocks, _, _ = html_text.parse(html)
    assert "\n".join(x for prior, _, x in blocks if prior >= 0) == text


def brute_margins(pages):
    """(site, node) -> margin, from [(site, html)] in the order of page_id, by the definition."""
    by_site = defaultdict(dict)
    for site, html in pages:
        blocks, orders, texts = html_text.parse(html)
        votes = {(p, None, o, c) for p, (o, c) in orders.items() if o or c} | {(n, s, t, 0) for (n, s), held in texts.items() for t in held}
        copy = "\n".join(t for prior, _, t in blocks if prior >= 0)
        by_site[site].setdefault(copy, votes)
    out = {}
    for site, copies in by_site.items():
        count, chars, sections = defaultdict(Counter), Counter(), {}
        for votes in copies.values():
            for node, section, feature, n in votes:
                count[node, section][feature] += 1
                chars[node] += n
                if section:
                    sections[node] = section
        found = {}
        for node, section in sections.items():
            orders = count[section, None]
            n = sum(orders.values())
            if n < html_text.LEAST_PAGES:
                continue
            presentation = -sum(k / n * math.log(k / n) for k in orders.values()) / math.log(n)
            held = count[node, section].values()
            content = 1 - sum(map(math.log, held)) / len(held) / math.log(n)
            found[node] = content * (html_text.HALF + html_text.PRESENTED * presentation + html_text.LENGTH * min(1, chars[section] / n / html_text.LONG))
        for node, x in found.items():
            out[site, node] = x - html_text.SHARE * max(found.values())
    return out


def test_margins_equal_brute_force(spark, larger):
    pages = load(spark, larger, "pages").select("page_id", F.monotonically_increasing_id().alias("row"), "html", host_of(F.col("url")).alias("host"), domain_of(host_of(F.col("url"))).alias("domain"))
    own = brute_margins([(r["host"], r["html"]) for r in sorted(pages.collect(), key=lambda r: r["page_id"])])
    trees = pages.select("page_id", "row", "host", "domain", html_text.parsed(F.col("html")).alias("p")).select("page_id", "row", "host", "domain", "p.*")
    got = {(r["host"], r["node"]): r["margin"] for r in html_text.margins(html_text.votes_of(trees)).collect()}
    expected = {(host, html_text._hash(node)): m for (host, node), m in own.items()}
    assert expected
    assert all(got[k] == pytest.approx(m, abs=1e-5) for k, m in expected.items())
    assert len(got) > len(expected)  # small hosts are judged by their domain


def test_article_is_found_without_names(spark, larger):
    """Without class names and article elements, only the tree can tell the article from the advert beside it."""
    pages = load(spark, larger, "pages")
    blank = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", ' class="[^"]*"', ""), "(</?)article", "$1div"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(blank.select("page_id", "url", "html")).collect()}
    named = {r["page_id"]: r["text"] for r in queries.op1_html_text(spark, larger).collect()}
    assert got == named


def test_tree_decides_inside_an_article(spark):
    """A box without a name that says the same in every article goes; the headings and paragraphs around it stay."""
    page = "<article><h1>Title {i}</h1>{paragraphs}<div>Join our list</div><p>Last {i}</p></article>"
    rows = [(i, "https://a.b/x", page.format(i=i, paragraphs=f"<p>Words of {i}</p>" * (i % 7 + 1))) for i in range(30)]
    got = texts_of(spark, rows)
    assert all(got[i] == "\n".join([f"Title {i}", *[f"Words of {i}"] * (i % 7 + 1), f"Last {i}"]) for i in range(30))


def test_copies_and_repeated_rows_do_not_turn_an_article_into_boilerplate(spark):
    rows = [(1, "https://a.b/x", "<article><h1>Copy</h1><p>The same</p></article>")] * 60 + [(i, "https://a.b/x", f"<article><h1>Title {i}</h1><p>Own {i}</p></article>") for i in range(2, 20)]
    assert all(text in ("Copy\nThe same", f"Title {i}\nOwn {i}") for i, text in texts_of(spark, rows).items())


def test_empty_table_and_long_page(spark):
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "<article>" + "<p>some words of a paragraph</p>" * 40_000 + "</article>"
    assert texts_of(spark, [(1, None, long)])[1].count("\n") == 39_999


def test_shuffled_joins_give_the_same(spark, larger, monkeypatch):
    """Beyond the bounds of broadcasts, judged nodes and copies are joined by shuffles."""
    want = {r["page_id"]: r["text"] for r in queries.op1_html_text(spark, larger).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_NODES", 0)
    assert {r["page_id"]: r["text"] for r in queries.op1_html_text(spark, larger).collect()} == want
