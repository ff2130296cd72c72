"""Pages judged as they arrive, by the same rules as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomaudit.operators import extract
from loomaudit.plans import page_rules
from loomaudit.sources import snapshot

FETCHES = "site string, page_url string, visit_ord bigint, status int, content_type string, headers map<string,string>, html string"


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of verdicts for fetches that arrive as Parquet files in a folder; stateless, so it needs no watermark."""
    fetched = spark.readStream.schema(FETCHES).parquet(folder)
    return page_rules.evaluate(snapshot.without_probes(extract.declared(extract.raw_pages(fetched))))
