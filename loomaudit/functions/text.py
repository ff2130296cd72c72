"""Text functions, as native expressions."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def trimmed(text: Column) -> Column:
    """Without white space at the ends, no-break spaces and byte-order marks included."""
    return F.regexp_replace(text, r"(?U)^[\s\x{feff}]+|[\s\x{feff}]+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(trimmed(text), F.lit("")) == ""


def utf16_length(text: Column) -> Column:
    """The length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def comma_tokens(text: Column) -> Column:
    """The comma-separated tokens, trimmed and lower-cased; none for null."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.lower(trimmed(t)))
    return F.filter(parts, lambda t: t != "")


def octets_decoded(text: Column) -> Column:
    """Percent-decoded; as it came where that fails."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def band(value: Column, ideal: tuple[float, float], acceptable: tuple[float, float]) -> Column:
    """ideal, acceptable or poor; bounds belong to their band."""
    return F.when(value.between(*ideal), "ideal").when(value.between(*acceptable), "acceptable").otherwise("poor")


def identity(category: Column | str, *parts: Column) -> Column:
    """A finding's stable id: its category and ten hex digits over its parts."""
    head = F.lit(category) if isinstance(category, str) else category
    joined = F.concat_ws(NUL, *(F.coalesce(p, F.lit("")) for p in parts))
    return F.concat(head, F.lit("-"), F.substring(F.sha2(joined, 256), 1, 10))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def leading_integer(text: Column) -> Column:
    """The integer that a text starts with, null if none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: ** crosses slashes, * and ? do not."""
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", pattern))
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def path_allowed(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusions first; then, if there are inclusions, one must match."""
    return ~matches_any(path, exclude) & (matches_any(path, include) if include else F.lit(True))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clipped(text: Column, most: int = 300) -> Column:
    """At most `most` characters of a text, with an ellipsis where there were more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def entities_decoded(text: Column) -> Column:
    """The few character references that a structured-data block may hold."""
    for a, b in (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def media_type(content_type: Column) -> Column:
    """The type without its parameters."""
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_image_type(content_type: Column) -> Column:
    return F.coalesce(media_type(content_type).startswith("image/"), F.lit(False))


def sizes_sorted(value: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.lower(trimmed(value)), r"\s+")), " ")


def parsed_sizes(value: Column) -> Column:
    """The WxH tokens and `any` of a sizes attribute; the rest is dropped."""
    return F.filter(F.split(F.lower(trimmed(F.coalesce(value, F.lit("")))), r"\s+"), lambda t: t.rlike(r"^(any|\d+x\d+)$"))


def locale_parts(tag: Column) -> Column:
    """struct<language, region>; null where the tag names no language."""
    parts = F.filter(F.split(F.lower(trimmed(tag)), "[-_]"), lambda t: t != "")
    language = F.get(parts, F.lit(0))
    region = F.get(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: t.rlike(r"^([a-z]{2}|\d{3})$")), F.lit(0))
    return F.when(language.rlike("^[a-z]{2,3}$"), F.struct(language.alias("language"), region.alias("region")))


def same_locale(a: Column, b: Column) -> Column:
    """Whether two tags can name one locale: a missing region fits any."""
    x, y = locale_parts(a), locale_parts(b)
    return F.coalesce((x["language"] == y["language"]) & (x["region"].isNull() | y["region"].isNull() | (x["region"] == y["region"])), F.lit(False))


def days_between(then: Column, now: Column) -> Column:
    """Whole days, not below zero."""
    return F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400), F.lit(0))


def _graphemes(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else len(regex.findall(r"\X", x)) for x in text.to_pylist()], pa.int32())


def grapheme_count(text: Column) -> Column:
    return F.arrow_udf(_graphemes, "int")(text)


def graphemes_cut(text: Column, most: int) -> Column:
    """At most `most` graphemes; what is longer ends in an ellipsis."""

    def cut(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            parts = [] if x is None else regex.findall(r"\X", x)
            out.append(None if x is None else x if len(parts) <= most else "".join(parts[: most - 1]).rstrip() + "…")
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")(text)
