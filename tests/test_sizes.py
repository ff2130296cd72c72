"""Queries over small page tables that have what only large ones have: an address twice, and sites of many pages."""

import pytest

from loomaudit import catalog, derived  # noqa: F401  (derived adds its queries)
from loomaudit.operators import links

SITE = "https://a.example"


def written(spark, tmp_path, urls):
    folder = tmp_path / "t"
    spark.createDataFrame([(i, u, "<html lang=\"en\"><head><title>A title of this page</title></head></html>") for i, u in enumerate(urls)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def same(spark, folder, name):
    """Spark writes a table as a folder; DuckDB asks for its files."""
    import duckdb

    from oracle import rows

    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    assert rows(catalog.QUERIES[name](spark, folder).toPandas()) == rows(c.sql(catalog.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """One site; two addresses stand in both of its families, some twice in one, some in a section that no crawl saw."""
    urls = ["https://b.example/en/0"] + [f"{SITE}/{('en', 'fr', 'de')[i % 3]}/{i}" for i in range(1, 40)]
    urls += [urls[7], urls[10], urls[8] + "/", urls[11], urls[20], urls[23], urls[5], urls[38], urls[38]]
    return written(spark, tmp_path_factory.mktemp("twice"), urls)


@pytest.mark.parametrize("name", ["cluster_combine", "cluster_heads_refused", "cluster_index_head", "clusters_only_in_heads"])
def test_an_address_in_two_families(spark, twice, name):
    same(spark, twice, name)


@pytest.mark.parametrize("name", ["sitemap_entries_unprobed"])
def test_an_entry_twice_is_left_twice(spark, twice, name):
    same(spark, twice, name)


@pytest.mark.parametrize("budget, within", [(0, 0), (1, 1), (2, 2), (3, 3), (9, 4)])
def test_a_budget_counts_every_entry(spark, budget, within):
    entries = spark.createDataFrame([(SITE, "x", 1), (SITE, "x", 1), (SITE, "x", 2), (SITE, "y", 3)], "site string, loc string, ord int")
    none = spark.createDataFrame([], "page_url string, status int"), spark.createDataFrame([], "url string, status int, final_url string")
    left = [r["in_budget"] for r in links.entry_probes(entries, *none, budget=budget)[1].collect()]
    assert (len(left), sum(left)) == (4, within)


@pytest.mark.parametrize("name", ["sitemap_uncrawled"])
def test_an_uncrawled_entry_twice_counts_twice(spark, twice, name):
    same(spark, twice, name)


def test_more_entries_than_a_live_run_keeps(spark, tmp_path):
    same(spark, written(spark, tmp_path, [f"{SITE}/en/{i}" for i in range(5100)]), "sitemap_entries")
