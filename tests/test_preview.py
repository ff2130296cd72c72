import json

import pytest
from pyspark.sql import functions as F

from loomaudit.operators import extract
from loomaudit.plans import preview, report
from loomaudit.plans import page_rules
from loomaudit.sources import snapshot

A = "https://a.example"
HOSTILE = '{"x": "</pre><script>alert(1)</script>", "a": ' + "[" * 400 + "1" + "]" * 400 + ', "long": [' + ",".join(['"y"'] * 12_000) + "]}"


def test_blocks_stay_bounded():
    deep = "[" * 50_000 + "]" * 50_000
    assert len(preview.pretty(deep)) <= preview.MOST_BLOCK + 20
    nested = '{"@type": ' * 900 + "1" + "}" * 900
    assert len(preview.pretty(nested)) <= preview.MOST_BLOCK + 20
    assert preview.pretty('{"b": [1, {"c": null}], "e": {}, "f": []}') == '{\n  "b": [\n    1,\n    {\n      "c": null\n    }\n  ],\n  "e": {},\n  "f": []\n}'
    assert json.loads(preview.pretty(json.dumps({"é": [True, 1.5, "x"]}))) == {"é": [True, 1.5, "x"]}
    assert preview.pretty(None) == "" and preview.pretty("{no") == "{no" and preview.pretty("x" * 30_000).endswith("… truncated")


@pytest.fixture(scope="module")
def pages(spark):
    def page(path, title, more=""):
        return (A, A + path, 0, 200, "text/html", {}, f"<html><head><title>{title}</title>{more}</head><body></body></html>")

    rows = [page("/en/x", "One &amp; only &lt;b&gt;", f"<meta property=og:locale content=en_US><script type='application/ld+json'>{HOSTILE.replace('</', '<\\/')}</script><script type='application/ld+json'> </script>"), page("/fr/x", "Un"), page("/en/alone", "y" * 1000)]
    raw = extract.declared(extract.raw_pages(spark.createDataFrame(rows, "site string, page_url string, visit_ord bigint, status int, content_type string, headers map<string,string>, html string")))
    return snapshot.without_probes(raw).withColumn("path", F.regexp_extract("page_url", "^[a-z]+://[^/?#]*([^?#]*)", 1))


def test_panels(spark, pages):
    findings = report.page_findings(page_rules.evaluate(pages))
    hydration = spark.createDataFrame([(f"{A}/en/x", "rendered", f"meta:late{i:03d}:1") for i in range(150)], "page_url string, side string, key string")
    html = {r["page_url"].removeprefix(A): r["html"] for r in preview.documents(pages, findings, hydration).collect()}
    x, fr, alone = html["/en/x"], html["/fr/x"], html["/en/alone"]
    assert "One &amp; only &lt;b&gt;" in x and "<b>" not in x and "<script" not in x
    assert "Translations (1)" in x and "<td>fr</td>" in x and f"{A}/fr/x" in x and "<td>en_US</td>" in fr and "Translations" not in alone
    assert "Share cards (7)" in x and "Structured data (2)" in x and "<td>empty</td>" in x and "… truncated" in x
    assert "Static and rendered (150)" in x and "and 50 more" in x and "late099" in x and "late100" not in x
    assert "Findings (" in alone and "canonical.missing" in alone and "y" * 301 not in alone and "…" in alone
    assert all(len(h) < 80_000 for h in html.values())


def test_files_once(spark, pages, tmp_path):
    findings = report.page_findings(page_rules.evaluate(pages))
    root = f"file://{tmp_path}/preview"
    assert {r["status"] for r in preview.write(root, pages, findings).collect()} == {"written"}
    assert {r["status"] for r in preview.write(root, pages, findings).collect()} == {"unchanged"}
    fewer = findings.where("rule_id <> 'viewport.missing'")
    assert {r["status"] for r in preview.write(root, pages, fewer, check=True).collect()} == {"stale"}
    assert len(list((tmp_path / "preview/pages").iterdir())) == 3
    assert "not rendered" in next((tmp_path / "preview/pages").iterdir()).read_text()
