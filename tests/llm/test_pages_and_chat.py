import base64
import hashlib

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from loomaudit.llm import chat_format, html_text, queries, url_filters, warc
from loomaudit.llm.common import load


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), queries.ORACLE_SQL[name], data)


# ---- html ----


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("text only", "text only"),
        ("<p>a&amp;b&nbsp; c<br>d<div>e<b>f</b>g</div>h", "a&b c\nd\nefg\nh"),
        ("<nav>x</nav><article><h1>T</h1><p>one<p>two</article><footer>f</footer>", "T\none\ntwo"),
        ("<div class='cookie-notice'>no</div><main>m<aside>z</aside></main>", "m"),
        ("<article>a</article><section id=comments><article class=comment>c</article></section>", "a"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>x", "x"),
        ("<!-- <p>no --><p>yes</p>", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<form>f<p>g</form><p>h", "h"),
        ("a < b", "a < b"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>x</article>", "Title\nx"),
    ],
)
def test_extraction(spark, html, text):
    df = spark.createDataFrame([(1, "https://a.b/", html)], "page_id bigint, url string, html string")
    assert html_text.extract(df).first()["text"] == text


def test_style_tree_removes_what_repeats(spark):
    rows = [(i, "https://a.b/x", f"<div class=top>Same words</div><div class=box>Hot {i % 2}</div><div class=body><p>Own text {i}</p></div>") for i in range(40)]
    rows += [(i, f"https://h{i}.b/", "<div class=top>Same words</div>") for i in range(100, 105)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(40))
    assert all(got[i] == "Same words" for i in range(100, 105))


def test_copies_of_an_article_stay(spark):
    rows = [(i, "https://a.b/x", "<article><p>A copy</article>") for i in range(40)] + [(None, None, "<p>x"), (1, "https://a.b/x", "")]
    got = [r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    assert sorted(got) == ["", *["A copy"] * 40, "x"]


def test_deep_pages(spark):
    html = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html_text.extract(spark.createDataFrame([(1, "https://a.b/", html)], "page_id bigint, url string, html string")).first()["text"] == "deep"


def test_pages_hold_their_documents(spark, data):
    docs = {r["doc_id"]: r["text"] for r in load(spark, data, "documents").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op1_html_text(spark, data).collect()}
    checked = 0
    for r in load(spark, data, "pages").withColumn("n", F.regexp_extract("url", r"/(\d+)", 1).cast("bigint")).collect():
        if r["n"] in docs:
            lines = [" ".join(x.split()) for x in docs[r["n"]].split("\n")]
            assert got[r["page_id"]].split("\n")[1:] == [x for x in lines if x]
            checked += 1
    assert checked


# ---- warc ----


def test_warc_query(spark, data):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in load(spark, data, "pages").collect()]
    first = {}
    for i, b in sorted(pages):
        first.setdefault(b, i)
    want = {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in pages}
    assert {r["page_id"]: tuple(r)[1:] for r in queries.op3_warc(spark, data).collect()} == want


def test_warc_edges(spark):
    rows = [(None, "http://a/b c\n", "x"), (5, None, "x"), (3, "u", "x"), (3, "v", "x"), (7, "w", None), (8, "w", ""), (9, "é", "é\r\n\r\n" * 300_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archives = warc.write_archives(warc.with_originals(df))
    got = warc.read_archives(warc.normalise(archives)).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == [("3", "response", "None"), ("3", "response", "None"), ("5", "revisit", "3"), ("7", "response", "None"), ("8", "revisit", "7"), ("9", "response", "None"), ("None", "revisit", "3")]
    assert next(r for r in got if r["page_id"] == 9)["payload_bytes"] == 6 * 300_000
    assert next(r for r in got if r["page_id"] is None)["url"] == "http://a/b%20c%0A"
    assert warc.read_archives(warc.normalise(warc.write_archives(warc.with_originals(df.limit(0))))).count() == 0


def test_every_member_stands_alone(spark):
    import gzip
    import json

    from loomaudit.llm.files import place

    df = spark.createDataFrame([(i, "u", f"p{i}") for i in range(20)], "page_id bigint, url string, html string")
    files = warc.normalise(warc.write_archives(warc.with_originals(df).coalesce(1))).collect()
    assert len(files) == 1
    _, name = place(files[0]["path"])
    data = open(name, "rb").read()
    index = [json.loads(x) for x in open(name + ".idx")]
    assert sum(e["length"] for e in index) == len(data) and len(index) == 20
    for e in index:
        record = gzip.decompress(data[e["offset"] : e["offset"] + e["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and e["id"].encode() in record


def test_truncated_archive():
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records_in(iter([warc.record_of(1, "u", b"x", None)[:-3]])))


# ---- url filters ----


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("https://EXAMPLE.net", "example.net", "", None, "allow"),
        ("https://Ä.net/X?y", "Ä.net", "/X", "net/", "block"),
        ("http://a.example.net/en/x#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://badexample.net/en/x", "badexample.net", "/en/x", "net/", "block"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://x.org/fr/?q", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://a.b?x://y/z", "a.b", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    urls = spark.createDataFrame([(1, url)], "page_id bigint, url string")
    got = url_filters.judged(urls, spark.createDataFrame([], "host string, bad int"), queries.RULES).first()
    assert tuple(got)[1:] == (host, path, rule, verdict)


def test_reputation(spark):
    hosts = spark.createDataFrame([("bad.a.com",), ("good.a.com",), ("new.b.com",), ("bad.a.com",)], "host string")
    outcomes = spark.createDataFrame([("bad.a.com", 1)] * 200 + [("good.a.com", 0)] * 200 + [("new.b.com", None)], "host string, bad int")
    got = {r["host"]: r for r in url_filters.reputation(hosts, outcomes).collect()}
    assert got["bad.a.com"]["bound"] > 0.9 and got["good.a.com"]["bound"] < 0.1 and got["new.b.com"]["n"] == 0
    assert 0.2 < got["new.b.com"]["rate"] < 0.8 and len(got) == 3


# ---- chat ----


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "a<", "<", "\\\\<|im_end|>\\", "", "line\nline", "%41+ b", "$1 \\1"]
    rows = [(1, i, "assistant" if i % 2 else "to ol\n+", t) for i, t in enumerate(tricky)] + [(2, 0, "user", "only"), (3, 0, None, None), (None, 0, "user", "x"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat_format.examples(df)
    got = made.select("conv_id", "n_turns", chat_format.turns_in(F.col("text")).alias("turns"), F.when(F.col("loss_start").isNotNull(), chat_format.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))).alias("loss")).collect()
    first = [(("assistant" if i % 2 else "to ol\n+"), t) for i, t in enumerate(tricky)]
    for r in (r for r in got if r["conv_id"] == 1):
        assert [tuple(t) for t in r["turns"]] == first[: r["n_turns"]]
        assert r["loss"] == (tricky[r["n_turns"] - 1] if r["n_turns"] % 2 == 0 else None)
    assert sorted((r["n_turns"], r["loss"]) for r in got if r["conv_id"] == 4) == [(2, "a"), (3, "b")]
    assert sorted(r["conv_id"] for r in got if r["conv_id"] != 1) == [2, 3, 4, 4]
    assert chat_format.examples(df.limit(0)).count() == 0


def test_chat_repeated_rows_and_a_long_text(spark):
    long = "<|im_end|>\\ text " * 60_000
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", long)], "conv_id bigint, turn bigint, role string, text string")
    (row,) = chat_format.examples(df).select("n_turns", chat_format.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"), chat_format.turns_in(F.col("text")).alias("turns")).collect()
    assert row["n_turns"] == 3 and row["loss"] == long and [t["text"] for t in row["turns"]] == ["hi", "hi", long]


def test_chat_conversation_of_many_turns(spark):
    """2,000 turns make 1,000 examples, each with all turns before it: its texts are as many as the square of the turns says."""
    df = spark.range(2000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('words of turn ', id) as text")
    got = chat_format.examples(df).agg(F.count("*").alias("n"), F.max("n_turns").alias("most"), F.sum(F.length("text")).alias("chars")).first()
    each = [len(f"<|im_start|>{'assistant' if i % 2 else 'user'}\nwords of turn {i}<|im_end|>\n") for i in range(2000)]
    assert (got["n"], got["most"]) == (1000, 2000) and got["chars"] == sum(sum(each[: i + 1]) for i in range(1, 2000, 2))


def test_warc_salted_join_gives_the_same(spark, data, monkeypatch):
    """Where copies are too many to broadcast, their digests go to several tasks each."""
    pages = load(spark, data, "pages").select("page_id", "url", "html").unionAll(spark.createDataFrame([(10**6 + i, "u", "<p>one payload</p>") for i in range(200)], "page_id bigint, url string, html string"))
    want = {tuple(r) for r in warc.with_originals(pages).select("page_id", "refers_to").collect()}
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert {tuple(r) for r in warc.with_originals(pages).select("page_id", "refers_to").collect()} == want
