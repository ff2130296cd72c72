"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes: a node is a path
of elements with their classes and, for containers, their place among siblings
alike. Pages vote on a node in two ways: by the order of the elements in a
container (presentation) and by the texts that a node holds (content). Both
count as entropies over the pages. The importance of a node with text is

    content * (HALF + PRESENTED * presentation + LENGTH * length)

where presentation and length (of text, up to LONG characters) are those of the
container that it stands in. A text that repeats from page to page says
nothing; a box of fixed form with a line of text says less than a branch whose
form and texts change from page to page. A node goes if its importance is
below SHARE of the highest on the host. What markup says of a block is added
as a prior: more for headings, paragraphs, articles and main elements, less for
navigation, headers, footers, asides, forms and for elements named as menus,
notices or adverts; what is named as reader comments or adverts never stays.
A form or a named element around an article or a main element, or around most
of a page that has no other text, is only a frame and has no such prior. The
same holds of elements that are hidden, and of those whose name has comments or
adverts for a part, as in reader-comments or ad-slot: they never stay unless
they are such a frame.

Pages of a host with the same text count as one page, so that copies of an
article do not turn it into boilerplate. A host with fewer than LEAST_PAGES
pages that hold a container is judged by the tree of its registered domain;
where that is small too, the prior alone decides.

A null or empty page has an empty text. Nodes deeper than DEPTH elements count
with their ancestor at that depth; their text is kept whole. A page whose row
repeats is extracted as often; a null URL counts with the empty host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomaudit.llm.common import hinted, small_enough, written
from loomaudit.llm.url_filters import domain_of, host_of

LEAST_PAGES = 10
HALF, PRESENTED, LENGTH, LONG, SHARE = 0.5, 0.3, 0.2, 600, 0.65
#: What markup adds to a block's importance.
HEADING, PARAGRAPH, ARTICLE, NAMED_AS, STRICT = 0.15, 0.05, 0.1, -0.3, -9.0
DEPTH = 24
#: Siblings alike from this number on are one node.
MOST_PLACES = 8
#: Judged nodes of all hosts that may be broadcast, so that no text is shuffled; beyond, the join is shuffled.
BROADCAST_NODES = 200_000

TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)*+)>|!--.*?(?:--!?>|\Z)|[!?/][^>]*>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/=>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TOKEN = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no text of a page.
NEVER = frozenset("button select option input textarea script style noscript template iframe svg object canvas head title".split())
BESIDE = frozenset("nav header footer aside menu dialog".split())
#: Elements that are part of the container around them.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd dl ul ol tr tbody thead tfoot caption blockquote pre address figure figcaption hgroup header".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer header masthead "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup social share sharing related recommended comment comments disqus respond pagination pager "
    "search login toolbar complementary contentinfo alert".split()
)
#: Words that may stand beside a name in a class or id, as in site-footer.
PLACES = frozenset("site page main top bottom left right primary secondary global bar box list section block area links".split())
#: Names that make even an article or main element no text.
NAMED_ARTICLE = frozenset("comment comments ad ads advert advertisement sponsored promo related recommended".split())
#: The same as a part of a longer name, unless another part says that the element is about something else.
COMMENTS = frozenset("comment comments commentlist commentslist disqus".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot adunit adbox sponsor sponsored sponsors promo promoted promotion outbrain taboola".split())
OTHERWISE = frozenset("no non not without free has have with open closed off on enabled disabled allow allowed supported blocker".split())
#: Styles that keep an element from being shown.
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CLOSED_BY = {k: frozenset(v.split()) for k, v in CLOSED_BY.items()}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _is_name(token: str, names: frozenset[str] = NAMED) -> bool:
    """Whether a whole class, id or role says what names hold."""
    parts = set(TOKEN.findall(token))
    return not names.isdisjoint(parts) and parts <= names | PLACES


def _has_part(token: str, names: frozenset[str]) -> bool:
    """Whether a part of a class or id is one of names, and none says otherwise."""
    parts = TOKEN.findall(token)
    return not names.isdisjoint(parts) and OTHERWISE.isdisjoint(parts)


def _named(attributes: str) -> tuple[list[str], bool, bool, bool]:
    """The words of an element's class, id and role, whether its role is main, whether it is not shown, and whether it is shown but not read out."""
    words, main, hidden, silent = [], False, False, False
    lower = attributes.lower()
    if "class" in lower or "id" in lower or "role" in lower or "style" in lower:
        for m in ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            if name in ("class", "id", "role"):
                value = CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower().split()
                main = main or name == "role" and value == ["main"]
                words += value
            elif name == "hidden":
                hidden = hidden or (m[2] or m[3] or m[4] or "").lower() != "until-found"
            elif name == "style":
                hidden = hidden or bool(HIDING.search(unescape(m[2] or m[3] or m[4] or "")))
            elif name == "aria-hidden":
                silent = (m[2] or m[3] or m[4] or "").strip().lower() == "true"
    return words, main, hidden, silent


class _Element:
    __slots__ = ("tag", "path", "section", "inner", "prior", "never", "inline", "deep", "frame", "above", "strict", "loose", "unseen", "holds", "chars", "places")

    def __init__(self, tag: str, attributes: str, parent: _Element | None):
        self.tag = tag
        self.inline = tag in INLINE
        words, main, hidden, silent = _named(attributes) if attributes and not attributes.isspace() else ([], False, False, False)
        self.inner, self.prior, self.never, self.deep = (parent.inner, parent.prior, parent.never, parent.deep + 1) if parent else (False, 0.0, False, 0)
        #: The nearest form or named element at or above this one, and for such an element the next one above.
        self.frame = self.above = parent.frame if parent else None
        self.strict, self.loose, self.holds, self.chars, self.places = False, False, False, 0, {}
        #: Text in an inline element that is not shown, which is part of the block around it.
        self.unseen = bool(parent and parent.unseen) or hidden and self.inline
        strict = any(_is_name(w, NAMED_ARTICLE) for w in words)
        if tag in ("article", "main") or main:
            if strict:
                self.prior = STRICT
            elif hidden or silent or any(_has_part(w, COMMENTS) for w in words):
                self.frame, self.loose = self, True
            elif self.prior > NAMED_AS:
                self.inner, self.prior = True, max(self.prior, ARTICLE)
                for x in self.frames():
                    x.holds = True
        elif tag not in ("html", "body"):
            self.never = self.never or tag in NEVER
            if tag in BESIDE and not (tag == "header" and self.inner):
                self.prior = min(self.prior, NAMED_AS)
            loose = not self.inline and (hidden or silent) or any(_has_part(w, COMMENTS | ADVERTS) for w in words)
            if tag == "form" or loose or any(map(_is_name, words)):
                self.frame, self.strict, self.loose = self, strict, loose
            if self.prior >= 0:
                self.prior += HEADING if tag in HEADINGS else PARAGRAPH if tag == "p" else 0.0
        if parent and (self.inline or parent.deep >= DEPTH):
            self.path, self.section = parent.path, parent.section
            return
        label = tag + ("." + ".".join(sorted(words)) if words else "")
        if tag not in PARTS and parent:
            place = parent.places[label] = min(parent.places.get(label, 0) + 1, MOST_PLACES)
            label += f"#{place}"
        self.path = (parent.path if parent else "") + "/" + label
        self.section = parent.section if parent and tag in PARTS else self.path

    def frames(self) -> Iterator[_Element]:
        x = self.frame
        while x:
            yield x
            x = x.above


def parse(html: str | None) -> tuple[list[tuple[float, str, str]], dict[str, tuple[str, int]], dict[tuple[str, str], set[str]]]:
    """A page as (blocks, orders, texts): blocks are (prior, the node that holds it, text); orders gives each container's elements in order and its number of characters; texts gives the texts of (node, container)."""
    root = _Element("html", "", None)
    stack, words = [root], []
    found: list[tuple[_Element, str]] = []
    orders: dict[str, list[str]] = {root.path: []}
    chars: dict[str, int] = {}
    texts: dict[tuple[str, str], set[str]] = {}

    def end_block(where: _Element) -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text and not where.never:
                texts.setdefault((where.path, where.section), set()).add(text)
                chars[where.section] = chars.get(where.section, 0) + len(text)
                found.append((where, text))
                for x in where.frames():
                    x.chars += len(text)

    def close(upto: int) -> None:
        if not all(x.inline for x in stack[upto:]):
            end_block(stack[-1])
        del stack[upto:]

    at, n = 0, len(html or "")
    while at < n:
        m = TAG.search(html, at)
        start = m.start() if m else n
        if start > at and not stack[-1].unseen:
            words.append(unescape(html[at:start]))
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                if tag not in INLINE:
                    end_block(stack[-1])
            continue
        if tag in VOID:
            if tag not in INLINE:
                end_block(stack[-1])
            continue
        if tag in RAW:
            closing = CLOSING[tag].search(html, at)
            at = closing.end() if closing else n
            continue
        if tag == "html":
            continue
        if tag not in INLINE:
            end_block(stack[-1])
            closed = CLOSED_BY.get(tag)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or closed and stack[i].tag in closed:
                    close(i)
                    break
                if not stack[i].inline:
                    break
            orders[stack[-1].section].append(tag)
        made = _Element(tag, m[3], stack[-1])
        orders.setdefault(made.section, [])
        stack.append(made)
    end_block(stack[-1])
    close(1)

    def framed(x: _Element, least: float) -> float:
        """What the frames around a block say: nothing where they hold an article, or more than `least` characters."""
        worst = 0.0
        for f in x.frames():
            worst = min(worst, STRICT if f.strict else 0.0 if f.holds or f.chars > least else STRICT if f.loose else NAMED_AS)
        return worst

    least = float("inf")
    if not any(x.prior >= 0 and framed(x, least) >= 0 for x, _ in found):
        least = sum(len(text) for x, text in found if x.prior >= 0) / 2
    blocks = [(min(x.prior, f) if (f := framed(x, least)) else x.prior, x.path, text) for x, text in found]
    return blocks, {path: (" ".join(order), chars.get(path, 0)) for path, order in orders.items()}, texts


_BLOCK = pa.list_(pa.struct([("prior", pa.float32()), ("node", pa.int64()), ("text", pa.string())]))
_VOTE = pa.list_(pa.struct([("node", pa.int64()), ("section", pa.int64()), ("feature", pa.int64()), ("chars", pa.int64())]))
PARSED = T.StructType(
    [
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("prior", T.FloatType()), T.StructField("node", T.LongType()), T.StructField("text", T.StringType())]))),
        T.StructField("votes", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("node", "section", "feature", "chars")]))),
        T.StructField("copy", T.LongType()),
    ]
)


def _parsed(html: pa.Array) -> pa.Array:
    blocks, votes, copies = [], [], []
    known: dict[str, int] = {}

    def node(path: str) -> int:
        if path not in known:
            known[path] = _hash(path)
        return known[path]

    for page in html:
        found, orders, texts = parse(page.as_py())
        blocks.append([{"prior": prior, "node": node(path), "text": text} for prior, path, text in found])
        votes.append(
            [{"node": node(path), "section": None, "feature": _hash(order), "chars": chars} for path, (order, chars) in orders.items() if order or chars]
            + [{"node": node(path), "section": node(section), "feature": _hash(text), "chars": 0} for (path, section), held in texts.items() for text in held]
        )
        copies.append(_hash("\n".join(text for prior, _, text in found if prior >= 0)))
    return pa.StructArray.from_arrays([pa.array(blocks, _BLOCK), pa.array(votes, _VOTE), pa.array(copies, pa.int64())], ["blocks", "votes", "copy"])


def parsed(html: Column) -> Column:
    """struct<blocks, votes, copy> of every page; copy is a hash of its text."""
    return F.arrow_udf(_parsed, PARSED)(html)


def votes_of(trees: DataFrame) -> DataFrame:
    """(host, domain, node, section, feature, k, chars): how many pages vote for each feature, from trees (row, page_id, host, domain, copy, votes). Of pages alike the one with the smallest page_id votes."""
    first = trees.groupBy("host", "copy").agg(F.min(F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "row")).alias("first")).select("first.row")
    copies = written(trees.select("row").join(first, "row", "left_anti"), "page-copies")
    voting = trees.join(hinted(copies, small_enough(copies, BROADCAST_NODES)), "row", "left_anti")
    votes = voting.select("host", "domain", F.explode("votes").alias("v")).select("host", "domain", "v.*")
    return votes.groupBy("host", "domain", "node", "section", "feature").agg(F.count("*").alias("k"), F.sum("chars").alias("chars"))


def importance(votes: DataFrame, site: str) -> DataFrame:
    """(site, node, pages, importance) of the nodes that hold text, from votes (site, node, section, feature, k, chars): k pages vote for a feature of a node, an order (no section, chars in all) or a text."""
    counted = votes.groupBy(site, "node", "section", "feature").agg(F.sum("k").cast("double").alias("k"), F.sum("chars").alias("chars"))
    orders = counted.where("section is null").groupBy(site, F.col("node").alias("section")).agg(F.sum("k").alias("pages"), F.sum(F.col("k") * F.ln("k")).alias("klnk"), F.sum("chars").alias("chars"))
    texts = counted.where("section is not null").groupBy(site, "node", "section").agg(F.avg(F.ln("k")).alias("mean_ln"))
    base, several = F.ln("pages"), F.col("pages") > 1
    presentation = F.when(several, (base - F.col("klnk") / F.col("pages")) / base).otherwise(1.0)
    content = F.when(several, 1 - F.col("mean_ln") / base).otherwise(1.0)
    length = F.least(F.lit(1.0), F.col("chars") / F.col("pages") / LONG)
    return texts.join(orders, [site, "section"]).select(site, "node", "pages", (content * (HALF + PRESENTED * presentation + LENGTH * length)).alias("importance"))


def margins(votes: DataFrame) -> DataFrame:
    """(host, node, margin) of the nodes that a tree judges, from votes (host, domain, node, section, feature, k, chars): by how much a node's importance exceeds SHARE of the highest of its site."""

    def judged(site: str) -> DataFrame:
        found = importance(votes, site).where(F.col("pages") >= LEAST_PAGES)
        best = found.groupBy(site).agg(F.max("importance").alias("best"))
        return found.join(best, site).select(site, "node", (F.col("importance") - SHARE * F.col("best")).alias("margin"))

    nodes = votes.where("section is not null").select("host", "domain", "node").distinct()
    own, wider = judged("host"), judged("domain").withColumnRenamed("margin", "wider")
    both = nodes.join(own, ["host", "node"], "left").join(wider, ["domain", "node"], "left")
    return both.select("host", "node", F.coalesce("margin", "wider").cast("float").alias("margin")).where("margin is not null")


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, text)."""
    host = host_of(F.col("url"))
    read = pages.select("page_id", "url", F.xxhash64(host).alias("host"), F.xxhash64(domain_of(host)).alias("domain"), parsed(F.col("html")).alias("parsed"))
    trees = written(read.select("page_id", "url", "host", "domain", "parsed.*").withColumn("row", F.monotonically_increasing_id()), "page-blocks")
    counted = written(votes_of(trees), "page-votes")
    # A node between these bounds stays or goes by the prior, as one that no tree judges.
    judged = written(margins(counted).where((F.col("margin") < 0) | (F.col("margin") + NAMED_AS >= 0)), "page-nodes")
    by_host = judged.groupBy("host").agg(F.collect_list(F.struct("node", "margin")).alias("judged"))
    joined = trees.select("page_id", "url", "host", "blocks").join(hinted(by_host, small_enough(judged, BROADCAST_NODES)), "host", "left")
    margin = lambda b: F.coalesce(F.get(F.filter("judged", lambda j: j["node"] == b["node"]), 0)["margin"], F.lit(0.0).cast("float"))
    kept = F.filter("blocks", lambda b: margin(b) + b["prior"] >= 0)
    return joined.select("page_id", "url", F.coalesce(F.array_join(F.transform(kept, lambda b: b["text"]), "\n"), F.lit("")).alias("text"))
