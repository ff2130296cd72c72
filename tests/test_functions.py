import pytest
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U


@pytest.mark.parametrize(
    ("href", "base", "out"),
    [
        ("HTTPS://Ex.COM:443/a/../b", None, "https://ex.com/b"),
        ("http://a.b", None, "http://a.b/"),
        ("/x?q=1#f", "https://a.b/c/d", "https://a.b/x?q=1#f"),
        ("y", "https://a.b/c/d?z", "https://a.b/c/y"),
        ("?n=2", "https://a.b/c/d?z", "https://a.b/c/d?n=2"),
        ("", "https://a.b/c?z#f", "https://a.b/c?z"),
        ("//other.c/p", "https://a.b/", "https://other.c/p"),
        ("../../..", "https://a.b/c/d/e", "https://a.b/"),
        ("a|b é", "https://a.b/", "https://a.b/a|b%20%C3%A9"),
        ("https://a.b:8080/x", None, "https://a.b:8080/x"),
        ("mailto:a@b", "https://a.b/", "mailto:a@b"),
        ("https:\\\\a.b\\c", None, "https://a.b/c"),
        ("x", None, None),
        (None, None, None),
        ("http://", None, None),
        ("http://a b/", None, None),
    ],
)
def test_parse_url(href, base, out):
    found = U.parse_url(href, base)
    assert (found and found[7]) == out


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("out")).first()["out"]


def test_keys(spark):
    u = U.parsed(F.col("u"))
    assert one(spark, U.same_page_key(u), u="https://a.b/x//?q=1#f") == "https://a.b/x?q=1"
    assert one(spark, U.route_key(u, F.col("u")), u="https://a.b/") == "/"
    assert one(spark, U.route_key(u, F.col("u")), u="no url") == "no url"
    assert one(spark, U.target_key(u, F.col("u")), u="https://a.b/x/") == "https://a.b/x"
    assert one(spark, U.canonical_url(u), u="https://a.b/x/#f") == "https://a.b/x"
    assert one(spark, U.canonical_url(u), u="ftp://a.b/x/") is None
    assert one(spark, U.entry_url(F.col("u")), u="a.b") == "https://a.b"
    assert one(spark, U.entry_url(F.col("u")), u="ftp://a.b") is None


@pytest.mark.parametrize(("path", "route", "locale"), [("/fr/about", "/about", "fr"), ("/pt-BR", "/", "pt-br"), ("/about/x", "/about/x", "x-default"), ("", "/", "x-default"), ("/doc/a", "/a", "doc")])
def test_split_route(spark, path, route, locale):
    out = one(spark, U.split_route(F.col("p")), p=path)
    assert (out["route"], out["locale"]) == (route, locale)


def test_text(spark):
    t = F.col("t")
    assert one(spark, X.utf16_length(t), t="a😀") == 3
    assert one(spark, X.trimmed(t), t=" ﻿ x \n") == "x"
    assert one(spark, X.comma_tokens(t), t=" NoIndex, ,follow") == ["noindex", "follow"]
    assert one(spark, X.octets_decoded(t), t="/caf%C3%A9+x") == "/café+x"
    assert one(spark, X.octets_decoded(t), t="/%zz") == "/%zz"
    assert one(spark, X.leading_integer(t), t=" 1200px") == 1200
    assert one(spark, X.entities_decoded(t), t="&amp;quot;") == "&quot;"
    assert one(spark, X.html_escaped(t), t="<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, X.grapheme_count(t), t="é👨‍👩‍👧") == 2
    assert one(spark, X.graphemes_cut(t, 3), t="abcdef") == "ab…"
    assert one(spark, X.sizes_sorted(t), t="32x32  16X16") == "16x16 32x32"
    assert one(spark, X.same_locale(t, F.lit("fr_FR")), t="fr") is True
    assert one(spark, X.same_locale(t, F.lit("fr_FR")), t="fr-CA") is False
    assert one(spark, X.identity("seo", t, F.lit("b")), t="a") == "seo-59b271ae1b"


def test_glob():
    import re

    assert re.match(X.glob_regex("/blog/*"), "/blog/x") and not re.match(X.glob_regex("/blog/*"), "/blog/x/y")
    assert re.match(X.glob_regex("/blog/**"), "/blog/x/y") and re.match(X.glob_regex("/a?c.html"), "/abc.html") and not re.match(X.glob_regex("/a?c.html"), "/abcxhtml")
