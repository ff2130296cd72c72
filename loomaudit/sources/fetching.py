"""Fetching as an operator: a DataFrame of URLs in, the same rows with their answers out.

URLs are dealt by host in a shuffle, so that a host is met by few tasks and the
pace of each is a share of the host's: a host with most of all URLs has up to
`lanes` tasks, and all of them together ask no faster than one host bears. What
gets no answer is asked once more when the task has asked for everything else,
which is the spacing that a busy server needs.

Answers differ from run to run: store them (`graph.stored`) before use, as
`fetched` itself leaves that to its caller. No URL passes through the driver.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomaudit.functions.urls import parse_url
from loomaudit.sources import web

#: Tasks that may ask one host, hosts that a task asks at once, URLs of a task that are under way together.
LANES, HOSTS_AT_ONCE, ROWS = 4, 8, 256
ANSWER = "struct<site: string, page_url: string, status: int, content_type: string, headers: map<string,string>, redirect_count: int, duration_ms: bigint, body_bytes: bigint, html: string, reason: string, method: string, head: binary, attempts: int>"
_ARROW = pa.struct(
    [
        ("site", pa.string()), ("page_url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("redirect_count", pa.int32()),
        ("duration_ms", pa.int64()), ("body_bytes", pa.int64()), ("html", pa.string()), ("reason", pa.string()), ("method", pa.string()), ("head", pa.binary()), ("attempts", pa.int32()),
    ]
)
#: What is asked again behind everything else; other probes try again at once.
AGAIN_LATER = ("page", "asset")
#: Reasons that a second try does not change.
LASTING = ("redirect loop", "not an http(s) URL")

Ask = Callable[[DataFrame], DataFrame]


class _Pace:
    """Lets calls for a host through one at a time, `wait` seconds apart."""

    def __init__(self, wait: float):
        self.wait, self.free = wait, defaultdict(float)

    def __call__(self, host: str) -> None:
        if self.wait:
            time.sleep(max(0.0, self.free[host] - time.monotonic()))
            self.free[host] = time.monotonic() + self.wait


def _ask_all(urls: list[str | None], probe: str, timeout: float, pace: _Pace, attempt: int) -> list[dict]:
    """The answers to URLs, in their order: a host's one after another, several hosts side by side. Never raises."""
    by_host: dict[str, list[int]] = defaultdict(list)
    for i, url in enumerate(urls):
        parsed = parse_url(url) if url else None
        by_host[parsed[1] or "" if parsed else ""].append(i)
    out: list[dict] = [{}] * len(urls)

    def one_host(host: str, places: list[int]) -> None:
        for i in places:
            pace(host)
            try:
                row = web.fetch(urls[i] or "", timeout, retries=int(probe not in AGAIN_LATER), probe=probe)
            except Exception as error:  # whatever a server or a URL brings about is an answer of status 0
                row = {"site": None, "page_url": urls[i], "status": 0, "content_type": None, "headers": {}, "redirect_count": 0, "duration_ms": 0, "body_bytes": 0, "html": None, "reason": type(error).__name__, "method": None}
            row = {k: v for k, v in row.items() if k != "requested_url"}
            out[i] = {"head": None} | row | {"headers": list(row["headers"].items()), "attempts": attempt}

    with ThreadPoolExecutor(HOSTS_AT_ONCE) as pool:
        list(pool.map(one_host, by_host, by_host.values()))
    return out


def fetched(urls: DataFrame, probe: str = "page", timeout: float = web.TIMEOUT_S, pace_s: float = 0.0, lanes: int = LANES, second_pass: bool = True, tasks: int | None = None) -> DataFrame:
    """urls with `answer` (ANSWER) for each row's requested_url; other columns stay. A column named answer is replaced. pace_s: seconds between two requests to a host. tasks: how many wait for answers; as many as a shuffle has by default, whatever the size of the table, as URLs are small and answers slow."""
    if probe not in web.PROBES:
        raise ValueError(f"unknown probe {probe!r}: one of {', '.join(web.PROBES)}")
    urls = urls.select(*(F.col(f"`{c}`") for c in urls.columns if c.lower() != "answer"))
    names, schema = urls.columns, T.StructType([*urls.schema.fields, *T.StructType.fromDDL(f"answer {ANSWER}").fields])
    at = names.index("requested_url")
    host, lane = F.lower(F.regexp_extract("requested_url", "^[A-Za-z]+://([^/?#]*)", 1)), F.pmod(F.xxhash64("requested_url"), F.lit(lanes))
    many = tasks or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = urls.repartition(many, F.coalesce(host, F.lit("")), F.coalesce(lane, F.lit(0)))

    def batch_of(rows: list[dict], answers: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(answers, _ARROW)], names=[*names, "answer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace, behind, kinds = _Pace(pace_s * lanes), [], None
        for batch in batches:
            kinds = batch.schema
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                answers = _ask_all([r[at] for r in rows], probe, timeout, pace, 1)
                again = [second_pass and probe in AGAIN_LATER and a["status"] == 0 and a["reason"] not in LASTING for a in answers]
                behind += [r for r, wait in zip(rows, again, strict=True) if wait]
                done = [k for k, wait in enumerate(again) if not wait]
                yield batch_of([rows[k] for k in done], [answers[k] for k in done], kinds)
        for start in range(0, len(behind), ROWS):
            rows = behind[start : start + ROWS]
            yield batch_of(rows, _ask_all([r[at] for r in rows], probe, timeout, pace, 2), kinds)

    return dealt.mapInArrow(run, schema)


def asking(probe: str = "page", timeout: float = web.TIMEOUT_S, pace_s: float = 0.0, lanes: int = LANES) -> Ask:
    """`fetched` with its settings, for what takes a way to ask."""
    return lambda urls: fetched(urls, probe, timeout, pace_s, lanes)


def from_snapshot(answers: DataFrame) -> Ask:
    """A way to ask that looks answers up instead: answers (url, status, page_url, content_type, html); what is not there did not answer."""
    known = answers.select(F.col("url").alias("requested_url"), F.struct("page_url", "status", "content_type", "html").alias("known")).dropDuplicates(["requested_url"])
    none = {"site": "string", "headers": "map<string,string>", "redirect_count": "int", "duration_ms": "bigint", "body_bytes": "bigint", "method": "string", "head": "binary"}

    def ask(urls: DataFrame) -> DataFrame:
        both = urls.join(known, "requested_url", "left")
        fields = {"page_url": F.coalesce("known.page_url", "requested_url"), "status": F.coalesce("known.status", F.lit(0)), "content_type": F.col("known.content_type"), "html": F.col("known.html"), "reason": F.when(F.col("known.status").isNull(), "network"), "attempts": F.lit(1)}
        fields |= {n: F.lit(None).cast(t) for n, t in none.items()}
        order = T.StructType.fromDDL(f"answer {ANSWER}")["answer"].dataType.names
        return both.select(*urls.columns, F.struct(*(fields[n].alias(n) for n in order)).alias("answer"))

    return ask
