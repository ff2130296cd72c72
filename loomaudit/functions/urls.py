"""URLs: parsed as browsers parse them, and the keys that the auditor joins on."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomaudit.functions.hosts import ascii_host

PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
PARTS = ("scheme", "host", "port", "origin", "path", "query", "fragment", "href")
URL = "struct<" + ", ".join(f"{p}: string" for p in PARTS) + ">"
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", re.S)
_PATH_SAFE = frozenset(map(ord, "!$%&'()*+,-./0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_abcdefghijklmnopqrstuvwxyz|~"))
_QUERY_SAFE = _PATH_SAFE | set(map(ord, "?`{}")) - {ord("'")}
_FRAGMENT_SAFE = _PATH_SAFE | set(map(ord, "?#{}"))


def _encoded(text: str, safe: frozenset[int]) -> str:
    return "".join(chr(b) if b in safe else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def _host(text: str) -> str | None:
    if text.startswith("["):
        return text.lower() if text.endswith("]") else None
    return ascii_host(text)


def _dotless(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")[1:]
    for i, s in enumerate(segments):
        plain = s.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        if plain in (".", ".."):
            if i == len(segments) - 1:
                out.append("")
        else:
            out.append(s)
    return "/" + "/".join(out)


@lru_cache(maxsize=50_000)
def parse_url(href: str | None, base: str | None = None) -> tuple[str | None, ...] | None:
    """PARTS of a URL, resolved against base; None if it is none. Schemes other than http(s), ws(s) and ftp keep what follows as their path."""
    if href is None:
        return None
    text = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(33)))))
    text, hashed, fragment = text.partition("#")
    m = _SCHEME.match(text)
    scheme, rest = (m[1].lower(), m[2]) if m else (None, text)
    above = parse_url(base) if base and (scheme is None or scheme in PORTS and not rest.replace("\\", "/").startswith("//")) else None
    if scheme is None:
        if above is None or above[0] not in PORTS:
            return None
        scheme = above[0]
    elif scheme not in PORTS:
        tail = _encoded(fragment, _FRAGMENT_SAFE)
        path, mark, query = rest.partition("?")
        return (scheme, "", "", "null", path, mark + query, hashed + tail, f"{scheme}:{rest}{hashed}{tail}")
    elif above is not None and above[0] != scheme:
        above = None
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    if rest.startswith("//") or above is None:
        authority, _, path = rest.lstrip("/").partition("/") if not rest.startswith("//") else rest[2:].lstrip("/").partition("/")
        path = "/" + path
        host, colon, port = authority.rpartition("@")[2].rpartition(":")
        if not colon or not (port.isdigit() or port == ""):
            if colon and not authority.rpartition("@")[2].startswith("["):
                return None
            host, port = authority.rpartition("@")[2], ""
        host = _host(host)
        if host is None:
            return None
        port = "" if port == "" or str(int(port)) == PORTS[scheme] else str(int(port))
    else:
        host, port = above[1], above[2]
        if rest.startswith("/"):
            path = rest
        elif rest:
            path = above[4].rpartition("/")[0] + "/" + rest
        else:
            path = above[4]
            if not mark:
                mark, query = above[5][:1], above[5][1:]
    path = _encoded(_dotless(path), _PATH_SAFE)
    query = "?" + _encoded(query, _QUERY_SAFE) if query else ""
    origin = f"{scheme}://{host}" + (f":{port}" if port else "")
    tail = "#" + _encoded(fragment, _FRAGMENT_SAFE) if fragment else ""
    return (scheme, host, port, origin, path, query, tail, f"{origin}{path}{'?' if mark and not query else query}{'#' if hashed and not tail else tail}")


def _parsed(href: pa.Array, base: pa.Array) -> pa.Array:
    rows = [parse_url(h, b) for h, b in zip(href.to_pylist(), base.to_pylist(), strict=True)]
    return pa.array([None if r is None else dict(zip(PARTS, r, strict=True)) for r in rows], pa.struct([(p, pa.string()) for p in PARTS]))


def parsed(href: Column, base: Column | None = None) -> Column:
    """struct<PARTS> of a URL, resolved against base; null if it is none."""
    return F.arrow_udf(_parsed, URL)(href, F.lit(None).cast("string") if base is None else base)


def is_absolute_http(url: Column) -> Column:
    """Of a parsed URL."""
    return F.coalesce(url["scheme"].isin("http", "https"), F.lit(False))


def _without_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def same_page_key(url: Column) -> Column:
    """Origin, path without slashes at its end, and query, of a parsed URL; the root keeps its slash."""
    path = F.when(F.length(url["path"]) > 1, _without_slashes(url["path"])).otherwise(url["path"])
    return F.concat(url["origin"], path, url["query"])


def route_key(url: Column, raw: Column) -> Column:
    """Path and query, without the origin; the raw text where it is no URL."""
    path = _without_slashes(url["path"])
    return F.coalesce(F.concat(F.when(path == "", "/").otherwise(path), url["query"]), raw)


def target_key(url: Column, raw: Column) -> Column:
    """As route_key, with the origin."""
    path = _without_slashes(url["path"])
    return F.coalesce(F.concat(url["origin"], F.when(path == "", "/").otherwise(path), url["query"]), raw)


def canonical_url(url: Column, keep_slash: bool = False) -> Column:
    """Without fragment and, unless kept, one slash at the end of its path; null unless http(s)."""
    path = url["path"] if keep_slash else F.when(F.length(url["path"]) > 1, F.regexp_replace(url["path"], "/$", "")).otherwise(url["path"])
    return F.when(is_absolute_http(url), F.concat(url["origin"], path, url["query"]))


def entry_url(text: Column) -> Column:
    """What a user types as an http(s) URL: https where no scheme is given, null for other schemes."""
    t = F.trim(text)
    return F.when(t.rlike("(?i)^https?://"), t).when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:(?!\d)") | (t == ""), None).otherwise(F.concat(F.lit("https://"), t))


LOCALE_SHAPE = r"(?i)^[a-z]{2,3}(-[a-z]{2}|-\d{3})?$"


def segments(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")


def locale_prefix(path: Column) -> Column:
    """The first segment, lower-cased, if it is shaped like a locale; else null."""
    first = F.get(segments(path), F.lit(0))
    return F.when(first.rlike(LOCALE_SHAPE), F.lower(first))


def split_route(path: Column) -> Column:
    """struct<route, locale>: the path behind a locale prefix, and the prefix; x-default where there is none."""
    parts, locale = segments(path), locale_prefix(path)
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    plain = F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)
    return F.struct(F.when(locale.isNotNull(), F.concat(F.lit("/"), rest)).otherwise(plain).alias("route"), F.coalesce(locale, F.lit("x-default")).alias("locale"))


def safe_url(text: Column) -> Column:
    """A URL that may be put into a document as a link or an image: an absolute http(s) one, as browsers write it; null for anything else."""
    url = parsed(text)
    return F.when(is_absolute_http(url), url["href"])
