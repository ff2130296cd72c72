"""Sitemaps: documents parsed, found in the order that a site names them."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CHILDREN, MOST_URLS = 50, 5000
#: The protocol's limit of a document.
MOST_BYTES = 50 << 20
ENTRY = "ord: int, loc: string, lastmod: string, changefreq: string, priority: string, alternates: array<struct<hreflang: string, href: string>>"
PARSED = f"struct<kind: string, bytes: bigint, entries: array<struct<{ENTRY}>>>"
_ARROW = pa.struct(
    [
        ("kind", pa.string()),
        ("bytes", pa.int64()),
        ("entries", pa.list_(pa.struct([("ord", pa.int32()), *((n, pa.string()) for n in ("loc", "lastmod", "changefreq", "priority")), ("alternates", pa.list_(pa.struct([("hreflang", pa.string()), ("href", pa.string())])))]))),
    ]
)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _inflated(data: bytes) -> bytes | None:
    """Packed bytes, unpacked as far as MOST_BYTES and one more, so that a small bomb stays small; None where they are not what they say."""
    out, rest = b"", data
    while rest and len(out) <= MOST_BYTES:
        unpacker = zlib.decompressobj(31)
        try:
            out += unpacker.decompress(rest, MOST_BYTES + 1 - len(out))
        except zlib.error:
            return None
        if not unpacker.eof:
            return out if len(out) > MOST_BYTES else None
        rest = unpacker.unused_data
    return out


def read_document(body: bytes | None) -> dict:
    """kind (index, urlset or unknown), size unpacked, and its entries; of an index, its children. Read piece by piece, an entry at a time; what follows the first MOST_BYTES is not read, and the size is then one more than that."""
    data = body or b""
    if data[:2] == b"\x1f\x8b":
        unpacked = _inflated(data)
        if unpacked is None:
            return {"kind": "unknown", "bytes": len(data), "entries": []}
        data = unpacked
    parser, kind, entries, depth, root = ET.XMLPullParser(("start", "end")), "unknown", [], 0, None
    try:
        for at in range(0, min(len(data), MOST_BYTES), 1 << 16):
            parser.feed(data[at : min(at + (1 << 16), MOST_BYTES)])
            for event, item in parser.read_events():
                depth += 1 if event == "start" else -1
                if event == "start" and depth == 1:
                    root, kind = item, {"sitemapindex": "index", "urlset": "urlset"}.get(_local(item.tag), "unknown")
                elif event == "end" and depth == 1:
                    if found := _entry(item, {"index": "sitemap", "urlset": "url"}.get(kind)):
                        entries.append({"ord": len(entries), **found})
                    root.clear()
        if len(data) <= MOST_BYTES:
            parser.close()
    except ET.ParseError:
        return {"kind": "unknown", "bytes": len(data), "entries": []}
    return {"kind": kind, "bytes": len(data), "entries": entries}


def _entry(item: ET.Element, wanted: str | None) -> dict | None:
    """What an element of a document says; None for others than `wanted` and those without a location."""
    if _local(item.tag) != wanted:
        return None
    found: dict = {"alternates": []}
    for x in item:
        name = _local(x.tag)
        if name in ("loc", "lastmod", "changefreq", "priority"):
            found.setdefault(name, (x.text or "").strip())
        elif name == "link" and (x.get("rel") or "").lower() == "alternate" and x.get("href"):
            found["alternates"].append({"hreflang": x.get("hreflang") or "", "href": x.get("href")})
    return found if found.get("loc") else None


def _documents(body: pa.Array) -> pa.Array:
    return pa.array([read_document(x) for x in body.to_pylist()], _ARROW)


def parsed(body: Column) -> Column:
    """PARSED of a document's bytes, packed or not."""
    return F.arrow_udf(_documents, PARSED)(body.cast("binary"))


def entry_count(body: Column) -> Column:
    """A cheap count of entries, without parsing."""
    return F.regexp_count(body, F.lit(r"(?i)<url\b")) + F.regexp_count(body, F.lit(r"(?i)<sitemap\b"))


def children(responses: DataFrame) -> DataFrame:
    """(site, url) that the indexes among responses (site, url, status, body) name, MOST_CHILDREN of a site at most."""
    read = responses.where("status between 200 and 299").select("site", parsed(F.col("body")).alias("doc")).where("doc.kind = 'index'")
    each = read.select("site", F.explode("doc.entries").alias("e")).groupBy("site", F.col("e.loc").alias("url")).agg(F.min("e.ord").alias("ord"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("ord", "url"))).where(F.col("n") <= MOST_CHILDREN).select("site", "url")


def discover(sites: DataFrame, declared: DataFrame, responses: DataFrame, most_children: int = MOST_CHILDREN, most_urls: int | None = MOST_URLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, entries, diagnostics) from sites (site: an origin), declared (site, url, line) and responses (site, url, status, body).

    The first candidate that parses ends the search: what robots.txt names, in its order, then the two usual places. An index gives its first children; an entry belongs to the first document that lists it. Without most_urls, all entries of a site are kept."""
    usual = sites.select("site", F.explode(F.array(F.struct(F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.lit(2**30).alias("line")), F.struct(F.concat("site", F.lit("/sitemap_index.xml")).alias("url"), F.lit(2**30 + 1).alias("line")))).alias("c")).select("site", "c.*")
    candidates = declared.select("site", "url", "line").unionByName(usual)
    read = responses.withColumn("doc", F.when(F.col("status").between(200, 299), parsed(F.col("body"))))
    tried = candidates.join(read, ["site", "url"])
    sound = tried.where(F.col("doc.kind").isin("index", "urlset"))
    root = sound.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("line"))).where("n = 1").select("site", "url", "doc")
    children = root.where("doc.kind = 'index'").select("site", F.col("url").alias("parent"), F.explode("doc.entries").alias("e")).select("site", "parent", F.col("e.loc").alias("url"), F.col("e.ord").alias("ord"))
    children = children.groupBy("site", "parent", "url").agg(F.min("ord").alias("ord"))
    children = children.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("ord"))).where(F.col("n") <= most_children)
    below = children.join(read.select("site", "url", "status", "doc"), ["site", "url"], "left").select("site", "url", "parent", "ord", F.coalesce("doc.kind", F.lit("unreadable")).alias("kind"), "doc")
    above = root.select("site", "url", F.lit(None).cast("string").alias("parent"), F.lit(-1).alias("ord"), F.col("doc.kind").alias("kind"), "doc")
    every = above.unionByName(below)
    documents = every.select("site", "url", "parent", "ord", "kind", F.coalesce("doc.bytes", F.lit(0)).alias("bytes"), F.coalesce(F.size("doc.entries"), F.lit(0)).alias("entries"))
    listed = every.where("kind = 'urlset'").select("site", F.col("url").alias("document_url"), F.col("ord").alias("document_ord"), F.explode("doc.entries").alias("e")).select("site", "document_url", "document_ord", "e.*")
    first = listed.withColumn("n", F.row_number().over(Window.partitionBy("site", "loc").orderBy("document_ord", "ord"))).where("n = 1").drop("n")
    placed = first.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("document_ord", "ord")))
    entries = (placed if most_urls is None else placed.where(F.col("n") <= most_urls)).select("site", "document_url", "loc", "lastmod", "changefreq", "priority", "alternates", F.col("n").alias("ord"))
    counts = first.groupBy("site").agg(F.count("*").alias("urls"))
    faults = documents.where("parent is not null and kind <> 'urlset'").groupBy("site").agg(F.count("*").alias("child_errors"))
    broken = tried.groupBy("site").agg(F.bool_or(F.col("doc.kind") == "unknown").alias("unparsable"), F.bool_or(F.col("status") == 0).alias("unreachable"))
    diagnostics = (
        sites.select("site").distinct().join(root.select("site", F.col("url").alias("sitemap_url"), F.lit(True).alias("found")), "site", "left").join(counts, "site", "left").join(faults, "site", "left").join(broken, "site", "left")
    ).select(
        "site", "sitemap_url", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("child_errors", F.lit(0)).alias("child_errors"),
        F.coalesce("unparsable", F.lit(False)).alias("unparsable"), F.coalesce("unreachable", F.lit(False)).alias("unreachable"), (F.lit(False) if most_urls is None else F.coalesce("urls", F.lit(0)) >= most_urls).alias("truncated"),
    )
    return documents, entries, diagnostics


def or_crawled(sites: DataFrame, entries: DataFrame, diagnostics: DataFrame, crawl: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entries, diagnostics) with what a crawl finds in the sites (site, url: where to begin) whose sitemap is missing or lists nothing; `crawl` gives (site, url, place) of seeds (site, url, ord). Such entries name no document; `source` says sitemap or crawl."""
    silent = diagnostics.where("urls = 0").select("site")
    found = crawl(sites.join(silent, "site", "left_semi").select("site", "url", F.lit(0).alias("ord")))
    none = F.lit(None)
    crawled = found.select("site", none.cast("string").alias("document_url"), F.col("url").alias("loc"), *(none.cast(entries.schema[c].dataType).alias(c) for c in ("lastmod", "changefreq", "priority", "alternates")), F.col("place").cast("int").alias("ord"))
    counts = crawled.groupBy("site").agg(F.count("*").alias("crawled"))
    said = diagnostics.join(counts, "site", "left").withColumns({"source": F.when(F.col("crawled").isNull(), "sitemap").otherwise("crawl"), "urls": F.coalesce("crawled", "urls")}).drop("crawled")
    return entries.unionByName(crawled), said
