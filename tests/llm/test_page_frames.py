import pytest

from loomaudit.llm import html_text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='content with-sidebar'><article>a</article></div>", "a"),
        ("<div id=page class=nav-open><article>a</article><nav>n</nav></div>", "a"),
        ("<form><input><article>a</article></form>", "a"),
        ("<form><h1>T</h1><p>body</form>", "T\nbody"),
        ("<div class=sidebar><main>m</main></div>", "m"),
        ("<main><h1>T</h1><article>a</article></main>", "T\na"),
        ("<p>The body of the page<article>teaser</article>", "The body of the page\nteaser"),
        ("<article>a</article><div class=site-footer>f</div><section class=related><article>r</article></section>", "a"),
    ],
)
def test_frames_and_what_stands_beside_an_article(spark, html, text):
    df = spark.createDataFrame([(1, "https://a.b/", html)], "page_id bigint, url string, html string")
    assert html_text.extract(df).first()["text"] == text


def test_what_repeats_beside_an_article_goes(spark):
    rows = [(i, "https://a.b/x", f"<div class=strap>Same words</div><h1>T {i}</h1><article>Own {i}</article>") for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r["text"] == f"T {r['page_id']}\nOwn {r['page_id']}" for r in got)


COMPOUNDS = ["reader-comments", "comment-body", "article-comments", "user-comment", "entry-comments", "ad-slot", "advert-unit", "sponsored-content", "comments_list", "readerComments", "adsense", "promo-box"]
HIDDEN = ["hidden", 'style="display:none"', "style='color:red; DISPLAY : none'", 'aria-hidden="true"', 'style="visibility: hidden"', 'hidden=""']


@pytest.mark.parametrize("attribute", [*(f'class="{c}"' for c in COMPOUNDS), 'id="reader-comments"', *HIDDEN])
def test_comments_adverts_and_hidden_text_go_though_they_change_from_page_to_page(spark, attribute):
    """A host of 15 pages, each with its own article and its own text in the box beside it, or inside it."""
    page = "<html><body><nav><ul><li>Home</ul></nav><article><h1>Title {i}</h1><p>Own words of the page {i}, some more of them.</p>{inside}<p>The end of {i}</p></article>{beside}<footer>foot</footer></body></html>"
    box = "<{t} {a}><p>Box {i} says this and that</p><div>and {i} more</div></{t}>"
    rows = []
    for i in range(15):
        made = box.format(t=("div", "section", "aside")[i % 2], a=attribute, i=i)
        rows.append((i, "https://a.b/x", page.format(i=i, inside=made if i % 3 == 0 else "", beside=made if i % 3 else "")))
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r["text"] == f"Title {r['page_id']}\nOwn words of the page {r['page_id']}, some more of them.\nThe end of {r['page_id']}" for r in got)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='content-sidebar-wrap'><main>Body</main></div>", "Body"),
        ("<div class='post no-sidebar no-comments ad-free comments-open'><p>Body</p></div><p>x", "Body\nx"),
        ("<div class='has-ads layout'><article>a</article></div>", "a"),
        ("<div class='ad-layout'><article>a</article></div>", "a"),
        ("<div id=page aria-hidden=true><main>m</main></div>", "m"),
        ("<div class=comment-view><p>The whole of the page</p></div>", "The whole of the page"),
        ("<p>one <span hidden>two</span> three", "one three"),
        ("<p>one <b style='display:none'>two <i>and</i></b> three", "one three"),
        ("<p>one <span aria-hidden=true>two</span> three", "one two three"),
        ("<div hidden=until-found>found</div><p>x", "found\nx"),
        ("<article><p>a</p></article><article class=comment-body><p>c</p></article>", "a"),
        ("<article class=comment-free>a</article>", "a"),
        ("<div class=download>d</div><div class=shadow>s</div><div class=commentary>c</div>", "d\ns\nc"),
    ],
)
def test_what_only_sounds_like_it_stays(html, text):
    blocks, _, _ = html_text.parse(html)
    assert "\n".join(x for prior, _, x in blocks if prior >= 0) == text
