"""Live pages: a Spark data source that fetches URLs.

    spark.dataSource.register(WebFetch)
    spark.read.format("webfetch").option("urls", "https://a.example/ https://a.example/x").load()

Each URL is a row, whatever happens: status 0 and a reason where it does not
answer. URLs are dealt to partitions by host, so that one task paces a host.
The option `probe` says how to ask: a page is read; a link is asked for its
head, then read if it answers well or refuses that; an icon is read only if it
refuses. `live_checks`, `favicons` and `robots_files` make of the rows what an
audit takes.
"""

from __future__ import annotations

import email.utils
import http.client
import json
import random
import re
import socket
import ssl
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomaudit.functions import text as X
from loomaudit.functions.urls import parse_url
from loomaudit.operators import links
from loomaudit.sources.snapshot import is_healthy

SCHEMA = "site string, requested_url string, page_url string, status int, content_type string, headers map<string,string>, redirect_count int, duration_ms bigint, body_bytes bigint, html string, reason string, method string, visit_ord bigint"
MOST_REDIRECTS, MOST_BYTES, TIMEOUT_S = 10, 3 << 20, 15.0
#: Seconds: the longest wait before a second try, and the first of the waits that double.
MOST_WAIT_S, WAIT_S = 3.0, 0.3
PROBES = ("page", "link", "icon", "asset")
#: Bytes of an asset that are asked for: enough for the size of an image.
HEAD_BYTES = 8192
#: Types of bodies that are decoded.
TEXT_TYPE = re.compile(r"text/|application/(?:xhtml\+xml|xml|json|javascript|.*\+(?:xml|json))")


def fetch_once(url: str, method: str, timeout: float, most: int | None = None) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body) of one request, without following redirects; with `most`, only so many first bytes are asked for and read."""
    scheme, host, port, _, path, query, *_ = parse_url(url)
    kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
    connection = kind(host, int(port) if port else None, timeout=timeout)
    try:
        wanted = {"Accept-Encoding": "gzip"} if most is None else {"Range": f"bytes=0-{most - 1}", "Accept": "image/*"}
        connection.request(method, path + query, headers={"User-Agent": "loomaudit", **wanted})
        answer = connection.getresponse()
        headers = {k.lower(): v for k, v in answer.getheaders()}
        body = answer.read(most or MOST_BYTES) if method == "GET" else b""
        if headers.get("content-encoding") == "gzip":
            body = zlib.decompressobj(31).decompress(body, MOST_BYTES)
        return answer.status, headers, body
    finally:
        connection.close()


def _reason(error: Exception) -> str:
    if isinstance(error, TimeoutError):
        return "timeout"
    if isinstance(error, socket.gaierror):
        return "dns"
    if isinstance(error, ssl.SSLError):
        return "tls"
    return "network"


def wait_before(attempt: int, retry_after: str | None, now: float | None = None) -> float:
    """Seconds to wait before trying again: what Retry-After asks for, in seconds or as a date, else twice as long each time and a little more or less; MOST_WAIT_S at most."""
    if retry_after:
        try:
            return min(MOST_WAIT_S, max(0.0, float(retry_after)))
        except ValueError:
            pass
        try:
            then = email.utils.parsedate_to_datetime(retry_after).timestamp()
            return min(MOST_WAIT_S, max(0.0, then - (time.time() if now is None else now)))
        except (TypeError, ValueError):
            pass
    return min(MOST_WAIT_S, WAIT_S * 2**attempt + random.uniform(0, WAIT_S))


def _follow(url: str, method: str, timeout: float, most: int | None = None) -> dict:
    """The answer at the end of a URL's redirects: status 0 and a reason where there is none."""
    at, hops, seen = url, 0, set()
    while True:
        try:
            status, headers, body = fetch_once(at, method, timeout, most)
            reason = None
        except (OSError, http.client.HTTPException, zlib.error) as error:
            status, headers, body, reason = 0, {}, b"", _reason(error)
        target = parse_url(headers.get("location"), at) if 300 <= status < 400 else None
        if target is not None:
            seen.add(at)
            hops += 1
            if target[7] not in seen and hops <= MOST_REDIRECTS and target[0] in ("http", "https"):
                at = target[7]
                continue
            status, reason = 0, "redirect loop"
        return {"status": status, "headers": headers, "body": body, "reason": reason, "at": at, "hops": hops, "method": method}


def _ask(url: str, probe: str, timeout: float) -> dict:
    """One try, as the probe wants it."""
    if probe in ("page", "asset"):
        return _follow(url, "GET", timeout, HEAD_BYTES if probe == "asset" else None)
    head = _follow(url, "HEAD", timeout)
    refused = head["status"] in (405, 501)
    if not refused and (probe == "icon" or not 200 <= head["status"] < 300):
        return head
    whole = _follow(url, "GET", timeout)
    return head if whole["status"] == 0 and not refused else whole


def fetch(url: str, timeout: float = TIMEOUT_S, retries: int = 1, probe: str = "page") -> dict:
    """A row for one URL; follows redirects, tries again once where it does not answer, asks to wait or the server fails."""
    began, parsed = time.time(), parse_url(url)
    found = {"status": 0, "headers": {}, "body": b"", "reason": "not an http(s) URL", "at": url, "hops": 0, "method": None}
    if parsed is not None and parsed[0] in ("http", "https"):
        for attempt in range(retries + 1):
            found = _ask(url, probe, timeout)
            lasting = found["reason"] == "redirect loop" or found["status"] and found["status"] != 429 and found["status"] < 500
            if lasting or found["status"] == 501:
                break
            if attempt < retries:
                time.sleep(wait_before(attempt, found["headers"].get("retry-after")))
    kind = found["headers"].get("content-type", "").split(";")[0].strip().lower()
    text = found["body"].decode("utf-8", "replace") if not kind or TEXT_TYPE.match(kind) else None
    final = parse_url(found["at"])
    return {
        "site": final[3] if final else None, "requested_url": url, "page_url": found["at"], "status": found["status"], "content_type": kind or None, "headers": found["headers"], "redirect_count": found["hops"],
        "duration_ms": int(1000 * (time.time() - began)), "body_bytes": len(found["body"]), "html": text, "reason": found["reason"], "method": found["method"], **({"head": found["body"]} if probe == "asset" else {}),
    }


def live_checks(fetched: DataFrame) -> DataFrame:
    """(url, final_url, status, hops, verdict, reason), as `links.checks` gives it, of rows fetched as links."""
    loop = F.coalesce(F.col("reason") == "redirect loop", F.lit(False))
    soft = links.is_soft_not_found(F.col("status"), F.col("html"))
    http = F.col("requested_url").rlike("(?i)^https?://")
    verdict = links.verdict_of(F.col("status"), F.col("redirect_count"), loop, soft, http)
    return fetched.select(F.col("requested_url").alias("url"), F.col("page_url").alias("final_url"), "status", F.col("redirect_count").alias("hops"), verdict.alias("verdict"), F.when(http, F.coalesce("reason", links.reason_of(F.col("status"), loop, soft))).alias("reason"))


def favicons(fetched: DataFrame) -> DataFrame:
    """(site, found) of rows fetched as icons from /favicon.ico: it answers well, with the type of an icon."""
    origin = F.regexp_extract("requested_url", "^[a-z]+://[^/?#]*", 0)
    kind = X.media_type(F.coalesce("content_type", F.lit("")))
    return fetched.select(origin.alias("site"), (is_healthy(F.col("status")) & (kind.startswith("image/") | kind.isin("application/ico", "application/x-ico"))).alias("found"))


def robots_files(fetched: DataFrame) -> DataFrame:
    """(site, url, status, final_url, body) of rows fetched as pages from /robots.txt; only an answer of the right kind has a body."""
    origin = F.regexp_extract("requested_url", "^[a-z]+://[^/?#]*", 0)
    return fetched.select(origin.alias("site"), F.col("requested_url").alias("url"), "status", F.col("page_url").alias("final_url"), F.when(is_healthy(F.col("status")), F.col("html")).alias("body"))


class _Hosts(InputPartition):
    def __init__(self, urls: list[tuple[int, str]]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float, probe: str):
        if probe not in PROBES:
            raise ValueError(f"unknown probe {probe!r}: one of {', '.join(PROBES)}")
        self.urls, self.timeout, self.probe = urls, timeout, probe

    def partitions(self):
        by_host: dict[str, list[tuple[int, str]]] = {}
        for i, url in enumerate(self.urls):
            parsed = parse_url(url)
            by_host.setdefault(parsed[1] if parsed else "", []).append((i, url))
        return [_Hosts(x) for x in by_host.values()] or [_Hosts([])]

    def read(self, partition: _Hosts) -> Iterator[tuple]:
        for i, url in partition.urls:
            row = fetch(url, self.timeout, probe=self.probe)
            yield (*row.values(), i)


class WebFetch(DataSource):
    """Options: urls, separated by white space or as a JSON list; timeout in seconds; probe, one of PROBES."""

    @classmethod
    def name(cls) -> str:
        return "webfetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        urls = self.options.get("urls", "")
        return _Reader(json.loads(urls) if urls.lstrip().startswith("[") else urls.split(), float(self.options.get("timeout", TIMEOUT_S)), self.options.get("probe", "page"))
