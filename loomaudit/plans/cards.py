"""Share cards: what each surface shows of a page, and the type and colours of a generated card."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.functions import text as X


def _first(*named: tuple[str, Column]) -> Column:
    """struct<value, source> of the first that is not blank."""
    return F.coalesce(*(F.when(~X.blank(c), F.struct(X.trimmed(c).alias("value"), F.lit(n).alias("source"))) for n, c in named))


def cards(pages: DataFrame) -> DataFrame:
    """(page_url, surface, title, title_from, description, image, image_from) for seven surfaces of declared pages."""
    c = F.col
    image = F.get(c("og_images"), F.lit(0))["url"]
    og = (("og", c("og_title")), ("document", c("title")))
    twitter = (("twitter", c("twitter_title")), *og)
    og_text = (("og", c("og_description")), ("document", c("description")))
    og_image, twitter_image = (("og", image), ("twitter", c("twitter_image"))), (("twitter", c("twitter_image")), ("og", image))
    none = F.lit(None).cast("string")
    surfaces = [("open-graph", og, og_text, og_image), ("search", (("document", c("title")),), (("document", c("description")),), (("none", none),)), ("x", twitter, (("twitter", c("twitter_description")), *og_text), twitter_image), *((n, og, og_text, og_image) for n in ("linkedin", "slack", "discord", "whatsapp"))]

    def row(name: str, title, text, picture) -> Column:
        t, d, i = _first(*title), _first(*text), _first(*picture)
        return F.struct(F.lit(name).alias("surface"), t["value"].alias("title"), t["source"].alias("title_from"), d["value"].alias("description"), i["value"].alias("image"), i["source"].alias("image_from"))

    return pages.select("page_url", F.explode(F.array(*(row(*s) for s in surfaces))).alias("s")).select("page_url", "s.*")


def fitted_size(graphemes: Column, steps: list[tuple[int, int]], smallest: int) -> Column:
    """The font size for a title of so many graphemes, from steps (up to, size) in ascending order."""
    if any(a[0] >= b[0] for a, b in zip(steps, steps[1:], strict=False)):
        raise ValueError("steps must ascend")
    return reduce(lambda out, s: F.when(graphemes <= s[0], s[1]).otherwise(out), reversed(steps), F.lit(smallest))


def oklch_hex(lightness: Column, chroma: Column, hue: Column) -> Column:
    """#rrggbb of a colour; what lies outside sRGB is clamped. The matrices are fixed values of the published colour space."""
    radians = hue * math.pi / 180
    a, b = chroma * F.cos(radians), chroma * F.sin(radians)
    lms = [F.pow(lightness + x * a + y * b, F.lit(3.0)) for x, y in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.291485548))]
    rows = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))

    def byte(row: tuple[float, float, float]) -> Column:
        linear = sum((k * v for k, v in zip(row, lms, strict=True)), F.lit(0.0))
        gamma = F.when(linear <= 0.0031308, 12.92 * linear).otherwise(1.055 * F.pow(linear, F.lit(1 / 2.4)) - 0.055)
        return F.lpad(F.lower(F.hex(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), gamma)) * 255 + 0.5).cast("bigint"))), 2, "0")

    return F.concat(F.lit("#"), *(byte(r) for r in rows))


def block_of(css: str | None, scope: str) -> str:
    """What stands between the braces of the first rule whose selector is `scope`, nested blocks and all; nothing if no rule is. A mention that no brace follows is no rule."""
    text, at = css or "", -1
    while (at := text.find(scope, at + 1)) >= 0:
        rest = text[at + len(scope) :].lstrip()
        if rest.startswith("{"):
            depth = 0
            for i, sign in enumerate(rest):
                depth += (sign == "{") - (sign == "}")
                if not depth:
                    return rest[1:i]
            return rest[1:]
    return ""


def _coordinate(text: Column, whole: float | None) -> Column:
    """A number, or a percentage of `whole`; null for what is neither."""
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), text.try_cast("double"))
    if whole is None:
        return number
    share = F.regexp_extract(text, r"^(.*)%$", 1)
    return F.coalesce(number, F.when(text.endswith("%"), share.try_cast("double") / 100 * whole))


def palette(css: DataFrame, scope: str | None = None) -> DataFrame:
    """(name, hex) of the custom properties with a fixed oklch() value in css (text), outside comments; the first declaration of a name counts. With a scope, like :root or .dark, those of its block alone."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)/\*.*?\*/", "")
    if scope is not None:
        text = F.arrow_udf(lambda column: pa.array([block_of(x.as_py(), scope) for x in column], pa.string()), "string")(text)
    found = css.select(F.posexplode(F.regexp_extract_all(text, F.lit(r"--[\w-]+:\s*oklch\(\s*[^)]+?\s*\)"), F.lit(0))).alias("ord", "declaration"))
    values = F.regexp_extract("declaration", r"oklch\(\s*([^)/]+?)\s*(?:/[^)]*)?\)", 1)
    part = lambda i: F.get(F.split(values, r"\s+"), F.lit(i))
    parsed = found.select("ord", F.regexp_extract("declaration", r"--([\w-]+)", 1).alias("name"), _coordinate(part(0), 1.0).alias("l"), _coordinate(part(1), 0.4).alias("c"), _coordinate(part(2), None).alias("h"))
    fixed = parsed.where("l is not null and c is not null and h is not null")
    return fixed.groupBy("name").agg(F.min_by(F.struct("l", "c", "h"), "ord").alias("v")).select("name", oklch_hex(F.col("v.l"), F.col("v.c"), F.col("v.h")).alias("hex"))


def written_state(inputs_hash: Column, stored_hash: Column) -> Column:
    """Whether a generated file is absent, stale or unchanged, by the fingerprint of its inputs."""
    return F.when(stored_hash.isNull(), "absent").when(stored_hash == inputs_hash, "unchanged").otherwise("stale")
