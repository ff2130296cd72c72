"""What pages declare: one pass of a tokenizer, then native expressions.

`raw_pages` reads each document once into arrays of its meta, link, script and
anchor elements, in document order, wherever they stand. `declared` picks what
rules read from these arrays: last of a name wins, structured properties of an
image belong to the image before them.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U

META = ("name", "property", "http_equiv", "content", "charset")
LINK = ("rel", "href", "url", "hreflang", "sizes", "type", "title")
ANCHOR = ("tag", "raw", "url", "fragment", "rel", "text")


def _struct(names: tuple[str, ...]) -> str:
    return "array<struct<ord: int, " + ", ".join(f"{n}: string" for n in names) + ">>"


RAW = f"struct<title: string, html_lang: string, base: string, metas: {_struct(META)}, links: {_struct(LINK)}, scripts: array<struct<ord: int, raw: string>>, anchors: {_struct(ANCHOR)}>"
#: Elements other than anchors that name an asset, and the attribute that does.
ASSET_ATTRIBUTE = {"img": "src", "script": "src", "iframe": "src", "link": "href"}
FEEDS = ("application/rss+xml", "application/atom+xml", "application/feed+json")
ICON_RELS = ("icon", "apple-touch-icon", "shortcut icon")
JSON_LD_DEPTH = 100


#: Elements whose content is text, and those among them that pages show nothing of.
RAW_TEXT = frozenset("script style noscript iframe noembed noframes xmp plaintext textarea title".split())
#: Elements that leave the head open.
HEAD_ONLY = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
#: The parts of tables; what else stands right in a table is moved before it.
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th style script template".split())
CELLS = frozenset(("td", "th", "caption"))
#: What each part of a table ends by its own beginning.
ENDED_BY = {"caption": ("caption", "colgroup"), "colgroup": ("caption", "colgroup"), "tbody": ("caption", "colgroup", "tbody", "thead", "tfoot", "tr", "td", "th"), "tr": ("caption", "colgroup", "tr", "td", "th"), "td": ("caption", "colgroup", "td", "th")}
ENDED_BY |= {"thead": ENDED_BY["tbody"], "tfoot": ENDED_BY["tbody"], "th": ENDED_BY["td"]}


class _Place:
    """A place in document order: what stands here, and what was moved to the place."""

    __slots__ = ("items", "before")

    def __init__(self):
        self.items: list[dict | _Place] = []
        self.before: list[dict] = []


class _Head(HTMLParser):
    """Collects the elements of one document where a browser's tree would have them.

    Kept of the stack of open elements is what decides on that: the head, tables and their parts, templates, selects, drawings. The first element or text that no head holds ends it; what stands in a table, but in no cell, is moved before the table; a cell or a row ends those open before it; templates and elements of text hold no elements of the page; a select holds none but its options."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.titles: list[tuple[bool, str]] = []
        self.html_lang = self.base = None
        self.metas, self.links, self.scripts, self.anchors = [], [], [], []
        self.in_head, self.svg, self.select = True, 0, False
        self.top = _Place()
        #: The open tables, innermost last: [the place of the table, where its content goes, its open parts].
        self.tables: list[tuple[_Place, list[str]]] = []
        self.templates: list[int] = []
        self.title: list[str] | None = None
        self.script: list[str] | None = None
        self.text_of: str | None = None
        self.open_anchor: dict | None = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.svg and tag in ("svg", "title", "a", "script"):  # the slash counts in drawings alone
            self.handle_endtag(tag)

    def _put(self, element: dict, moved: bool) -> None:
        where = self.tables[-1][0] if self.tables else self.top
        (where.before if moved else where.items).append(element)

    def _in_table(self) -> bool:
        """Whether the innermost open element that counts is a table or a part of one that is no cell."""
        return bool(self.tables) and not CELLS.intersection(self.tables[-1][1])

    def _table_part(self, tag: str) -> None:
        if self.tables and tag in ENDED_BY:
            parts = self.tables[-1][1]
            while parts and parts[-1] in ENDED_BY[tag]:
                parts.pop()
            parts.append(tag)

    def handle_starttag(self, tag, attrs):
        if self.text_of is not None:
            return
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag in RAW_TEXT and not self.svg:
            self.text_of = tag
        if self.templates:
            self.templates[0] += tag == "template"
            if tag in RAW_TEXT:
                self.script = self.title = None
            return
        if tag == "template":
            self.templates.append(1)
            return
        if tag == "html" and self.html_lang is None:
            self.html_lang = a.get("lang")
        if self.select:
            if tag in ("select", "input", "textarea"):
                self.select = False
            if tag not in ("script", "input", "textarea"):
                return
        if tag not in HEAD_ONLY:
            self.in_head = False
        moved = False
        if tag == "table":
            if self._in_table() and not self.tables[-1][1]:
                self.tables.pop()
            here = _Place()
            self._put(here, self._in_table())
            self.tables.append((here, []))
        elif tag in TABLE_PARTS:
            self._table_part(tag)
        else:
            moved = self._in_table() and not (tag == "input" and a.get("type", "").lower() == "hidden")
        if tag == "svg":
            self.svg += 1
        elif tag == "select":
            self.select = True
        elif tag == "title" and not self.svg:
            self.title = []
        elif tag == "base" and self.base is None and a.get("href"):
            self.base = a["href"]
        elif tag == "meta":
            self.metas.append({"name": a.get("name"), "property": a.get("property"), "http_equiv": a.get("http-equiv"), "content": a.get("content"), "charset": a.get("charset")})
            self._put(self.metas[-1], moved)
        elif tag == "script" and (a.get("type") or "").strip().lower() == "application/ld+json":
            self.script = []
        if tag == "link":
            self.links.append({k: a.get(k) for k in ("rel", "href", "hreflang", "sizes", "type", "title")})
            self._put(self.links[-1], moved)
        source = a.get("href") if tag == "a" else a.get(ASSET_ATTRIBUTE.get(tag, ""))
        if tag == "a":
            self.open_anchor = None  # an anchor ends one that is open
        if source is not None and (tag == "a" or tag in ASSET_ATTRIBUTE):
            found = {"tag": tag, "raw": source, "rel": a.get("rel"), "text": [] if tag == "a" else None}
            self.anchors.append(found)
            self._put(found, moved)
            if tag == "a":
                self.open_anchor = found

    def handle_endtag(self, tag):
        if self.text_of is not None:
            if tag != self.text_of or tag == "plaintext":
                return
            self.text_of = None
        if self.templates:
            if tag == "template":
                self.templates[0] -= 1
                if not self.templates[0]:
                    self.templates.clear()
            return
        if tag == "title" and self.title is not None:
            self.titles.append((self.in_head, " ".join("".join(self.title).split())))
            self.title = None
        elif tag == "script" and self.script is not None:
            self.scripts.append({"raw": "".join(self.script)})
            self._put(self.scripts[-1], False)
            self.script = None
        elif tag == "svg":
            self.svg = max(0, self.svg - 1)
        elif tag == "head":
            self.in_head = False
        elif tag == "select":
            self.select = False
        elif tag == "a":
            self.open_anchor = None
        elif tag == "table" and self.tables:
            self.tables.pop()
        elif self.tables and tag in self.tables[-1][1]:
            parts = self.tables[-1][1]
            del parts[len(parts) - 1 - parts[::-1].index(tag) :]

    def handle_data(self, data):
        if self.templates:
            return
        if self.title is not None:
            self.title.append(data)
        elif self.script is not None:
            self.script.append(data)
        elif self.text_of is None:
            if self.in_head and not data.isspace():
                self.in_head = False
            if self.open_anchor is not None:
                self.open_anchor["text"].append(data)

    def number(self) -> None:
        """Gives every element its place in the tree's order; those moved before a table stand before all that it holds."""
        n, waiting = 0, [self.top]
        while waiting:
            item = waiting.pop()
            if isinstance(item, _Place):
                waiting += reversed([*item.before, *item.items])
            else:
                n += 1
                item["ord"] = n
        for found in (self.metas, self.links, self.scripts, self.anchors):
            found.sort(key=lambda x: x["ord"])


def _href(raw: str | None, base: str | None) -> str | None:
    if raw is None:
        return None
    found = U.parse_url(raw, base)
    return found[7] if found else raw


def _link_target(raw: str, base: str | None) -> tuple[str, str | None]:
    """A link's URL without its fragment, and the fragment; the raw text where it cannot be canonical."""
    found = U.parse_url(raw, base)
    if found is None or found[0] not in ("http", "https"):
        return raw.strip(), None
    return found[3] + found[4] + found[5], found[6][1:] or None


def read_page(html: str | None, url: str | None) -> dict:
    """RAW of one document."""
    page = _Head()
    page.feed(html or "")
    page.close()
    if page.script is not None:
        page.handle_endtag("script")
    page.number()
    if page.title is not None:
        page.titles.append((page.in_head, " ".join("".join(page.title).split())))
    base = _href(page.base, url) if page.base else url
    head = next((t for inside, t in page.titles if inside), "")
    title = head or next((t for _, t in page.titles if t), None)
    for link in page.links:
        link["url"] = _href(link["href"], base)
    for anchor in page.anchors:
        anchor["url"], anchor["fragment"] = _link_target(anchor["raw"], base)
        anchor["text"] = None if anchor["text"] is None else " ".join("".join(anchor["text"]).split())
    return {"title": title, "html_lang": page.html_lang, "base": base, "metas": page.metas, "links": page.links, "scripts": page.scripts, "anchors": page.anchors}


def _array(names: tuple[str, ...]) -> pa.DataType:
    return pa.list_(pa.struct([("ord", pa.int32()), *((n, pa.string()) for n in names)]))


RAW_ARROW = pa.struct([("title", pa.string()), ("html_lang", pa.string()), ("base", pa.string()), ("metas", _array(META)), ("links", _array(LINK)), ("scripts", _array(("raw",))), ("anchors", _array(ANCHOR))])


def _read(html: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([read_page(h, u) for h, u in zip(html.to_pylist(), url.to_pylist(), strict=True)], RAW_ARROW)


def raw_pages(fetches: DataFrame) -> DataFrame:
    """fetches (site, page_url, visit_ord, status, content_type, headers, html) with `raw` (RAW) in place of html."""
    return fetches.withColumn("raw", F.arrow_udf(_read, RAW)(F.col("html"), F.col("page_url"))).drop("html")


def last_of(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _named(metas: Column, name: str) -> Column:
    """The content of the last meta of a name."""
    return last_of(F.filter(metas, lambda m: (F.lower(m["name"]) == name) & m["content"].isNotNull()))["content"]


def _property(metas: Column, *names: str) -> Column:
    return F.filter(metas, lambda m: F.lower(m["property"]).isin(*names) & m["content"].isNotNull())


def og_images(metas: Column) -> Column:
    """The declared images, array<struct<url, secure_url, type, width, height, alt>>, each with the structured properties up to the next image."""
    images = _property(metas, "og:image", "og:image:url")

    def image(m: Column, i: Column) -> Column:
        upto = F.coalesce(F.get(images, i + 1)["ord"], F.lit(2**31 - 1))

        def own(name: str) -> Column:
            return F.filter(_property(metas, name), lambda p: (p["ord"] > m["ord"]) & (p["ord"] < upto))

        def size(name: str) -> Column:
            return last_of(F.filter(F.transform(own(name), lambda p: X.leading_integer(p["content"])), lambda n: n.isNotNull()))

        return F.struct(
            m["content"].alias("url"),
            last_of(own("og:image:secure_url"))["content"].alias("secure_url"),
            last_of(own("og:image:type"))["content"].alias("type"),
            size("og:image:width").alias("width"),
            size("og:image:height").alias("height"),
            last_of(own("og:image:alt"))["content"].alias("alt"),
        )

    return F.transform(images, image)


def declared(raw: DataFrame) -> DataFrame:
    """What rules read, a column for each fact; null where a page does not declare it."""
    r = F.col("raw")
    metas, links = r["metas"], r["links"]

    def of_rel(*rels: str) -> Column:
        return F.filter(links, lambda x: F.lower(x["rel"]).isin(*rels) & (F.coalesce(x["href"], F.lit("")) != ""))

    def og(name: str) -> Column:
        return last_of(_property(metas, f"og:{name}"))["content"]

    def twitter(*names: str) -> Column:
        return last_of(F.filter(metas, lambda m: F.lower(m["name"]).isin(*(f"twitter:{n}" for n in names)) & m["content"].isNotNull()))["content"]

    alternates = F.filter(of_rel("alternate"), lambda x: F.coalesce(x["hreflang"], F.lit("")) != "")
    charset = F.coalesce(
        last_of(F.filter(metas, lambda m: m["charset"].isNotNull()))["charset"],
        F.nullif(F.trim(F.regexp_extract(F.get(F.filter(metas, lambda m: (F.lower(m["http_equiv"]) == "content-type") & m["content"].rlike("(?i)charset=")), F.lit(0))["content"], r"(?i)charset=([^;]+)", 1)), F.lit("")),
    )
    canonical = last_of(of_rel("canonical"))
    return raw.select(
        *[c for c in raw.columns if c != "raw"],
        r["title"].alias("title"),
        r["html_lang"].alias("html_lang"),
        charset.alias("charset"),
        *(_named(metas, n).alias(n.replace("-", "_")) for n in ("description", "author", "viewport", "robots", "googlebot", "generator", "referrer", "theme-color", "color-scheme", "application-name")),
        F.filter(F.transform(F.split(_named(metas, "keywords"), ","), X.trimmed), lambda t: t != "").alias("keywords"),
        canonical["url"].alias("canonical"),
        canonical["href"].alias("canonical_raw"),
        F.try_element_at("headers", F.lit("x-robots-tag")).alias("x_robots"),
        *(og(n).alias(f"og_{n}") for n in ("title", "type", "url", "description", "site_name", "locale")),
        F.transform(_property(metas, "og:locale:alternate"), lambda m: m["content"]).alias("og_alternates"),
        og_images(metas).alias("og_images"),
        *(twitter(*n).alias(f"twitter_{n[0]}") for n in (("card",), ("site",), ("creator",), ("title",), ("description",), ("image", "image:src"), ("image:alt",))),
        F.transform(alternates, lambda x: F.struct(x["ord"], x["hreflang"], x["url"].alias("href"), (F.lower(x["hreflang"]) == "x-default").alias("is_default"))).alias("alternates"),
        F.transform(of_rel(*ICON_RELS), lambda x: F.struct(F.lower(x["rel"]).alias("rel"), x["url"].alias("href"), x["sizes"], x["type"], X.parsed_sizes(x["sizes"]).alias("parsed"))).alias("icons"),
        F.transform(F.filter(of_rel("alternate"), lambda x: (F.coalesce(x["hreflang"], F.lit("")) == "") & F.lower(x["type"]).isin(*FEEDS)), lambda x: F.struct(F.lower(x["type"]).alias("type"), x["url"].alias("href"), x["title"])).alias("feeds"),
        last_of(of_rel("manifest"))["url"].alias("manifest_href"),
        F.transform(of_rel("preconnect"), lambda x: x["url"]).alias("preconnects"),
        F.transform(of_rel("dns-prefetch"), lambda x: x["url"]).alias("dns_prefetches"),
        r["scripts"].alias("json_ld"),
        r["anchors"].alias("anchors"),
    )


def types_in(raw: str | None) -> list[str]:
    """The @type values of a structured-data block, in the order found, each once; nothing if it is no JSON."""
    try:
        start = json.loads(raw or "")
    except ValueError:
        return []
    out: dict[str, None] = {}
    stack = [(start, 0)]
    while stack:
        node, depth = stack.pop()
        if depth > JSON_LD_DEPTH:
            continue
        if isinstance(node, dict):
            kinds = node.get("@type")
            out.update(dict.fromkeys(k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)))
            stack += [(v, depth + 1) for k, v in reversed(node.items()) if k != "@type"]
        elif isinstance(node, list):
            stack += [(v, depth + 1) for v in reversed(node)]
    return list(out)


def json_ld(pages: DataFrame) -> DataFrame:
    """(page_url, index, raw, types, parse_error, is_empty) for each structured-data block; an empty one cannot be read either."""
    each = pages.select("page_url", F.posexplode("json_ld").alias("index", "script"))
    body = X.entities_decoded(F.col("script.raw"))
    return each.select("page_url", "index", body.alias("raw")).withColumns({"types": _types_of(F.col("raw")), "parse_error": F.try_parse_json("raw").isNull(), "is_empty": X.blank(F.col("raw"))})


def _types(raw: pa.Array) -> pa.Array:
    return pa.array([types_in(x) for x in raw.to_pylist()], pa.list_(pa.string()))


def _types_of(raw: Column) -> Column:
    return F.arrow_udf(_types, "array<string>")(raw)


def looks_client_rendered(page: DataFrame) -> Column:
    """Whether every signal of a rendered head is missing."""
    return (
        X.blank(F.col("title")) & X.blank(F.col("description")) & F.col("canonical").isNull() & X.blank(F.col("og_title")) & (F.size("og_images") == 0) & (F.size("alternates") == 0) & (F.size("json_ld") == 0)
    )


def hydration_delta(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """(page_url, side, key): meta and link declarations that only one of two passes over a page has."""

    def keys(pages: DataFrame) -> DataFrame:
        metas = F.transform("raw.metas", lambda m: F.concat_ws(":", F.lit("meta"), F.coalesce(m["name"], m["property"], m["http_equiv"], F.lit("charset")), F.coalesce(m["content"], m["charset"], F.lit(""))))
        links = F.transform("raw.links", lambda x: F.concat_ws(":", F.lit("link"), F.coalesce(x["rel"], F.lit("")), F.coalesce(x["url"], F.lit(""))))
        return pages.select("page_url", F.explode(F.array_distinct(F.concat(metas, links))).alias("key"))

    a, b = keys(static), keys(rendered)
    on = ["page_url", "key"]
    return a.join(b, on, "left_anti").withColumn("side", F.lit("static")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("rendered")))


MODES = ("auto", "static", "headless")


def inspected(static: DataFrame, rendered: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """Declared pages with `mode` (static or headless) and `escalation_blocked` (why not rendered, or null), chosen from two readings of the same pages.

    headless takes the rendered reading wherever there is one; auto only of pages that look as if a browser had still to write their head; static none. A page that should have been rendered and was not stays as it is and says so. Page URLs are taken to be distinct in each reading."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    wanted = F.lit(False) if mode == "static" else F.lit(True) if mode == "headless" else F.coalesce(looks_client_rendered(static), F.lit(False))
    own = static.withColumn("_wanted", wanted)
    none = F.lit(None).cast("string")
    if rendered is None:
        return own.withColumns({"mode": F.lit("static"), "escalation_blocked": F.when(F.col("_wanted"), "nothing was rendered").otherwise(none)}).drop("_wanted")
    there = rendered.select("page_url", F.lit(True).alias("_rendered"))
    flagged = own.join(there, "page_url", "left").withColumn("_taken", F.col("_wanted") & F.coalesce("_rendered", F.lit(False)))
    kept = flagged.where("not _taken").withColumns({"mode": F.lit("static"), "escalation_blocked": F.when(F.col("_wanted"), "this page was not rendered").otherwise(none)})
    taken = rendered.select(*static.columns).join(flagged.where("_taken").select("page_url"), "page_url", "left_semi").withColumns({"mode": F.lit("headless"), "escalation_blocked": none})
    columns = [*static.columns, "mode", "escalation_blocked"]
    return kept.select(*columns).unionByName(taken.select(*columns))
