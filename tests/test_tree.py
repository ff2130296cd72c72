"""Elements as a browser's tree would have them: cases worked out by hand from the standard's rules for trees."""

import pytest

from loomaudit.operators.extract import read_page


def read(html):
    return read_page(html, "https://a.example/")


@pytest.mark.parametrize(
    ("html", "order"),
    [
        ("<table><tr><td><a href=1>x</a></td></tr><a href=2>y</a></table><a href=3>z</a>", "213"),  # right in a row group: moved before the table
        ("<table><a href=1>x</a><tr><a href=2>y</a><td><a href=3>z</a></table>", "123"),
        ("<a href=0>o</a><table><tr><td><a href=1>x</a><table><a href=2>y</a><tr><td><a href=3>z</a></table><a href=4>w</a></table>", "01234"),
        ("<table><tr><td><a href=1>x</a><table><tr><td><a href=2>y</a></table><a href=3>z</a></table>", "123"),
        ("<table><tr><td>1<tr><td><a href=1>x</a></table>", "1"),
        ("<table><caption><a href=1>c</a></caption><a href=2>y</a><td><a href=3>z</a></table>", "213"),
        ("<table><tbody><tr><td></td></tr></tbody><tfoot><a href=1>f</a></tfoot></table><a href=2>e</a>", "12"),
        ("<table><tr><td><a href=1>x</a><table><table><a href=2>y</a></table></table>", "12"),
        ("<table><tr><th><a href=1>a</a><td><a href=2>b</a></tr><a href=3>m</a><tr><td><a href=4>c</a></table>", "3124"),
        ("<p><a href=1>x<a href=2>y</a></p>", "12"),
        ("</table></td><a href=1>x</a>", "1"),
    ],
)
def test_order_of_anchors(html, order):
    assert "".join(x["raw"] for x in read(html)["anchors"]) == order


def test_meta_and_link_in_a_table_are_moved_with_the_rest():
    page = read("<body><table><tr><td><a href=1>x</a></td></tr><meta name=m content=1><link rel=icon href=i></table>")
    assert page["metas"][0]["ord"] < page["links"][0]["ord"] < next(x["ord"] for x in page["anchors"] if x["tag"] == "a")


@pytest.mark.parametrize(
    ("html", "title"),
    [
        ("<head><title>One</title></head><body><title>Two</title>", "One"),
        ("<div>x</div><title>In the body</title>", "In the body"),  # the only one, wherever it stands
        ("<head><div></div><title>Late</title></head>", "Late"),
        ("<title></title><p>x<title>Second</title>", "Second"),  # an empty one says nothing
        ("<svg><title>drawing</title></svg><title>Page</title>", "Page"),
        ("<template><title>No</title></template><title>Yes</title>", "Yes"),
        ("<noscript><title>No</title></noscript><title>Yes</title>", "Yes"),
        ("<title>a &amp; b</title>", "a & b"),
        ("<title>never closed", "never closed"),
    ],
)
def test_title(html, title):
    assert (read(html)["title"] or "") == title


def test_a_title_of_the_head_wins_and_text_ends_the_head():
    assert read("text<title>First</title><title>Second</title>")["title"] == "First"
    assert read("<p>x</p><title>Body</title>")["title"] == "Body"
    assert read("<head> \n <meta name=a> <title>Head</title>")["title"] == "Head"


@pytest.mark.parametrize("shell", ["<template>{}</template>", "<noscript>{}</noscript>", "<textarea>{}</textarea>", "<iframe>{}</iframe>", "<xmp>{}</xmp>", "<noframes>{}</noframes>", "<template><template></template>{}</template>", "<select>{}</select>", "<script>{}</script>", "<title>{}</title>", "<!-- {} -->"])
def test_what_holds_no_elements_of_the_page(shell):
    page = read("<a href=before>b</a>" + shell.format("<a href=x>x</a><meta name=m><link rel=icon href=i>") + "<a href=behind>b</a>")
    assert [x["raw"] for x in page["anchors"] if x["tag"] == "a"] == ["before", "behind"]
    assert page["metas"] == [] and page["links"] == []


def test_template_does_not_hide_what_follows_it():
    page = read("<template><div><title>t</title><script type='application/ld+json'>{}</script></template><script type='application/ld+json'>{\"@type\": \"A\"}</script>")
    assert [x["raw"] for x in page["scripts"]] == ['{"@type": "A"}']


def test_slashes_close_nothing_outside_drawings():
    page = read("<a href=1 />text</a><svg><a href=2 /></svg><a href=3>x</a>")
    assert [(x["raw"], x["text"]) for x in page["anchors"]] == [("1", "text"), ("2", ""), ("3", "x")]


def test_anchors_end_one_another_and_keep_text_across_blocks():
    page = read("<a href=1>one<div>two</div></a><a href=2>three<a href=3>four</a>five")
    assert [(x["raw"], x["text"]) for x in page["anchors"]] == [("1", "onetwo"), ("2", "three"), ("3", "four")]


def test_language_of_a_later_html_element_counts():
    assert read("<p>x<html lang=fr>")["html_lang"] == "fr" and read("<html lang=en><html lang=fr>")["html_lang"] == "en"


def test_deep_and_broken_pages():
    page = read("<table>" * 3000 + "<tr><td><a href=1>x</a>")
    assert [x["raw"] for x in page["anchors"]] == ["1"]
    assert read("<table><tr><td>" * 3000 + "<a href=1>x")["anchors"][0]["raw"] == "1"
    assert read(None)["anchors"] == [] and read("<")["anchors"] == []
