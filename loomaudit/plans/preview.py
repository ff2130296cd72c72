"""The preview of an audit as HTML: a file for each page, written by tasks.

A page's file has its share cards, findings, translations, structured data and
what rendering changed in its head. Everything that a site says is escaped and
clipped, lists are cut off with their counts, and a block of structured data is
walked without recursion up to a number of characters, so that no page makes its
own preview large. Files go through `artefacts.write`: what has not changed is
not written again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.operators import extract
from loomaudit.plans import artefacts, cards, report

#: Characters of a block and of a value, and rows of a list, that are shown.
MOST_BLOCK, MOST_VALUE, MOST_ROWS = 20_000, 300, 100
VERSION = "1"


def _tokens(start: object) -> Iterator[str]:
    """The text of a JSON value, indented, bit by bit and without recursion."""
    waiting: list[tuple[str, object, int]] = [("value", start, 0)]
    while waiting:
        kind, item, depth = waiting.pop()
        if kind == "text":
            yield str(item)
        elif isinstance(item, dict | list) and item:
            ends, pairs = ("{}", item.items()) if isinstance(item, dict) else ("[]", ((None, x) for x in item))
            yield ends[0]
            waiting.append(("text", "\n" + "  " * min(depth, 40) + ends[1], depth))
            held = list(pairs)
            for i in range(len(held) - 1, -1, -1):
                key, value = held[i]
                waiting.append(("text", "," if i < len(held) - 1 else "", depth))
                waiting.append(("value", value, depth + 1))
                waiting.append(("text", "\n" + "  " * min(depth + 1, 40) + ("" if key is None else json.dumps(key, ensure_ascii=False) + ": "), depth))
        else:
            yield json.dumps(item, ensure_ascii=False)


def pretty(raw: str | None, most: int = MOST_BLOCK) -> str:
    """A block of structured data as it may be shown: indented JSON, cut at `most` characters; what is no JSON, or nested too deep to be read, as it stands, cut likewise."""
    try:
        start = json.loads(raw or "")
    except (ValueError, RecursionError):
        text = raw or ""
        return text if len(text) <= most else text[:most] + "\n… truncated"
    out, size = [], 0
    for token in _tokens(start):
        out.append(token)
        size += len(token)
        if size > most:
            return "".join(out)[:most] + "\n… truncated"
    return "".join(out)


def _pretty(raw: Column) -> Column:
    return F.arrow_udf(lambda column: pa.array([pretty(x.as_py()) for x in column], pa.string()), "string")(raw)


def _shown(value: Column, most: int = MOST_VALUE) -> Column:
    """A value, clipped and escaped; a dash for nothing."""
    return F.when(X.blank(value), F.lit('<span class="none">—</span>')).otherwise(X.html_escaped(X.clipped(value, most)))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))


def _listed(rows: DataFrame, html: Column, *order: Column | str) -> DataFrame:
    """(page_url, html, n): the first MOST_ROWS rows of each page joined, and how many there are; ranks beyond that never leave their tasks."""
    counts = rows.groupBy("page_url").agg(F.count("*").alias("n"))
    placed = rows.withColumn("html", html).withColumn("place", F.row_number().over(Window.partitionBy("page_url").orderBy(*order))).where(F.col("place") <= MOST_ROWS)
    joined = placed.groupBy("page_url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "html"))), lambda x: x["html"]), "").alias("html"))
    return joined.join(counts, "page_url")


def _panel(title: str, listed: DataFrame, name: str, head: str) -> DataFrame:
    """(page_url, name): the panel of a list."""
    more = F.when(F.col("n") > MOST_ROWS, F.concat(F.lit("<p>and "), (F.col("n") - MOST_ROWS).cast("string"), F.lit(" more</p>"))).otherwise("")
    body = F.concat(F.lit(f"<section><h2>{title} ("), F.col("n").cast("string"), F.lit(f")</h2><table><tr>{head}</tr>"), F.col("html"), F.lit("</table>"), more, F.lit("</section>"))
    return listed.select("page_url", body.alias(name))


def _heads(*names: str) -> str:
    return "".join(f"<th>{n}</th>" for n in names)


def documents(pages: DataFrame, findings: DataFrame, hydration: DataFrame | None = None) -> DataFrame:
    """(path, page_url, html) of declared pages (page_url once each, with site and path), findings (see `report`), and hydration (page_url, side, key), if pages were rendered."""
    shown = cards.cards(pages)
    surfaces = _panel("Share cards", _listed(shown, _row(_shown(F.col("surface")), _shown(F.col("title")), X.grapheme_count(F.coalesce("title", F.lit(""))).cast("string"), _shown(F.col("description")), _shown(F.col("image"))), "surface"), "cards", _heads("surface", "title", "graphemes", "description", "image"))
    found = _panel("Findings", _listed(findings, _row(_shown(F.col("severity")), _shown(F.col("rule_id")), _shown(F.col("summary"))), X.severity_rank(F.col("severity")), "rule_id", "id"), "found", _heads("severity", "rule", "what"))
    titles = pages.select(F.col("page_url").alias("sibling"), "title", "og_locale")
    others = report.siblings(pages.select("site", "page_url", "path")).join(titles, "sibling", "left")
    languages = _panel("Translations", _listed(others, _row(_shown(F.col("locale")), _shown(F.col("og_locale")), _shown(F.col("title")), _shown(F.col("sibling"))), "locale", "sibling"), "languages", _heads("locale", "og:locale", "title", "address"))
    blocks = extract.json_ld(pages)
    note = F.when(F.col("is_empty"), "empty").when(F.col("parse_error"), "cannot be read").otherwise(F.array_join("types", ", "))
    data = _panel("Structured data", _listed(blocks, _row(F.col("index").cast("string"), _shown(note), F.concat(F.lit("<pre>"), X.html_escaped(_pretty(F.col("raw"))), F.lit("</pre>"))), "index"), "data", _heads("block", "types", "content"))
    if hydration is None:
        changed = pages.select("page_url", F.lit('<section><h2>Static and rendered</h2><p class="none">Not established: the page was not rendered.</p></section>').alias("changed"))
    else:
        changed = _panel("Static and rendered", _listed(hydration, _row(_shown(F.col("side")), _shown(F.col("key"))), "side", "key"), "changed", _heads("only in", "what"))
    out = pages.select("page_url", "title")
    for part in (surfaces, found, languages, data, changed):
        out = out.join(part, "page_url", "left")
    body = F.concat(
        F.lit("<!DOCTYPE html><meta charset=utf-8><title>"), _shown(F.col("title")), F.lit("</title><h1>"), _shown(F.col("page_url")), F.lit("</h1>"),
        *(F.coalesce(n, F.lit("")) for n in ("cards", "found", "languages", "data", "changed")),
    )
    return out.select(F.concat(F.lit("pages/"), F.substring(F.sha2("page_url", 256), 1, 20), F.lit(".html")).alias("path"), "page_url", body.alias("html"))


def write(root: str, pages: DataFrame, findings: DataFrame, hydration: DataFrame | None = None, check: bool = False) -> DataFrame:
    """(path, status) of the files of `documents` below root, a URI that tasks reach."""
    made = documents(pages, findings, hydration).withColumn("fingerprint", artefacts.fingerprint(F.col("html"), F.lit(VERSION)))
    return artefacts.write(made, root, lambda due: due.withColumn("body", F.col("html").cast("binary")), check)
