"""Snapshots of fetched pages and probes, as tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.functions import text as X

FINDINGS = "id string, kind string, rule_id string, severity string, page_url string, summary string"


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as answered fetches: (site, page_url, visit_ord, status, content_type, headers, html); site is the origin."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(
        F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0).alias("site"), F.col("url").alias("page_url"), F.col("page_id").alias("visit_ord"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.create_map().cast("map<string,string>").alias("headers"), "html",
    )


def first_answers(fetched: DataFrame) -> DataFrame:
    """One row for each answered URL: the first visit's."""
    from pyspark.sql import Window

    order = Window.partitionBy("site", "page_url").orderBy("visit_ord")
    return fetched.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def is_healthy(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def is_html(content_type: Column) -> Column:
    """No type counts as HTML."""
    return X.media_type(F.coalesce(content_type, F.lit(""))).isin("", "text/html", "application/xhtml+xml")


def image_sizes(head: bytes | None) -> list[tuple[int, int]]:
    """The sizes in the first bytes of a PNG, JPEG or ICO; of an icon, each frame's; none for other formats."""
    data = head or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return [struct.unpack(">II", data[16:24])]
    if data[:4] == b"\0\0\1\0" and len(data) >= 6:
        (frames,) = struct.unpack("<H", data[4:6])
        rows = [data[6 + 16 * i : 8 + 16 * i] for i in range(frames)]
        return [(r[0] or 256, r[1] or 256) for r in rows if len(r) == 2]
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return [(width, height)]
            if marker == 0xFF or 0xD0 <= marker <= 0xD9 or marker == 1:
                at += 1 if marker == 0xFF else 2
                continue
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return []


def _sizes(head: pa.Array) -> pa.Array:
    return pa.array([[{"width": w, "height": h} for w, h in image_sizes(x)] for x in head.to_pylist()], pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32())])))


def asset_probes(asset_bytes: DataFrame) -> DataFrame:
    """(url, status, ok, content_type, sizes) from asset_bytes (url, status, content_type, head)."""
    sizes = F.arrow_udf(_sizes, "array<struct<width: int, height: int>>")(F.col("head"))
    return asset_bytes.select("url", "status", (is_healthy(F.col("status")) & X.is_image_type(F.col("content_type"))).alias("ok"), "content_type", sizes.alias("sizes"))


def wanted_assets(pages: DataFrame, external: bool = True) -> DataFrame:
    """(site, url) of the images and icons that declared pages name and a probe may ask for: absolute http(s) URLs, of the page's own site unless external."""
    named = pages.select("site", F.explode(F.concat(F.transform("og_images", lambda i: X.trimmed(i["url"])), F.transform("icons", lambda i: i["href"]))).alias("url")).distinct()
    origin = F.regexp_extract("url", "^(?i:https?)://[^/?#]+", 0)
    return named.where((origin != "") & (F.lit(external) | (F.lower(origin) == F.lower("site"))))


def with_probes(pages: DataFrame, probes: DataFrame, manifests: DataFrame) -> DataFrame:
    """Declared pages with `assets` (a map; empty where nothing was to be fetched), and the icons of their manifest from manifests (href, status, body).

    Where no probe pass ran, use `without_probes`: rules tell the two apart."""
    wanted = pages.select("page_url", F.explode(F.array_distinct(F.concat(F.transform("og_images", lambda i: X.trimmed(i["url"])), F.transform("icons", lambda i: i["href"])))).alias("url")).distinct()
    found = wanted.join(probes, "url").groupBy("page_url").agg(F.map_from_entries(F.collect_set(F.struct("url", F.struct("status", "ok", "content_type", "sizes")))).alias("found"))
    icon = "array<struct<src: string, sizes: string, type: string>>"
    parsed = F.try_parse_json("body")
    read = manifests.select(F.col("href").alias("manifest_href"), parsed.isNotNull().alias("manifest_parsed"), F.from_json("body", f"struct<icons: {icon}>")["icons"].alias("manifest_icons")).dropDuplicates(["manifest_href"])
    none = F.create_map().cast("map<string, struct<status: int, ok: boolean, content_type: string, sizes: array<struct<width: int, height: int>>>>")
    return pages.join(found, "page_url", "left").withColumn("assets", F.coalesce("found", none)).drop("found").join(read, "manifest_href", "left")


def without_probes(pages: DataFrame) -> DataFrame:
    """Declared pages where no probe ran: null assets, no manifest read."""
    assets = "map<string, struct<status: int, ok: boolean, content_type: string, sizes: array<struct<width: int, height: int>>>>"
    return pages.withColumns({"assets": F.lit(None).cast(assets), "manifest_parsed": F.lit(None).cast("boolean"), "manifest_icons": F.lit(None).cast("array<struct<src: string, sizes: string, type: string>>")})


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of an earlier run."""
    return spark.read.schema(FINDINGS).json(path)
