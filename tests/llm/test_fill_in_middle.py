import hashlib
import re

from oracle import assert_same
from pyspark.sql import functions as F

from loomaudit.llm import fill_in_middle, queries
from loomaudit.llm.common import load


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, transformed=90, suffix_first=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    drawn = digest(f"1:{'' if doc_id is None else doc_id}")
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= transformed:
        return doc_id, len(units), "plain", text, None, None
    if h[3] % 100 < suffix_first:
        return doc_id, len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return doc_id, len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


ODD = ["", " ", "a", "<P>", "x <S> y", "one two\nthree", "<<<P", "ab<", "😀😀 é中", "a" * 5000, "x1" * 3000, "\x00\t", "<P" * 40, "M><M", "S>a<S"]


def test_odd_texts_copies_and_nulls(spark):
    rows = [(i, t) for k, t in enumerate(ODD) for i in range(40 * k, 40 * k + 40)] + [(None, "some text here"), (None, None), (7, None), (3, "a b"), (3, "a b"), (3, "a c"), (-5, "so it goes on")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = fill_in_middle.transformed(docs)
    assert sorted(map(repr, (tuple(r) for r in made.collect()))) == sorted(repr(brute(*r)) for r in rows)
    back = made.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, (tuple(r) for r in back))) == sorted(repr((i, t or "")) for i, t in rows)


def test_rates_are_parameters(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words to cut, more or less").alias("text"))
    for rates in ((0, 0), (100, 0), (100, 100), (50, 50)):
        got = {r["doc_id"]: r["form"] for r in fill_in_middle.transformed(docs, *rates).collect()}
        assert got == {i: brute(i, "some words to cut, more or less", *rates)[2] for i in range(300)}


def test_empty_table_extra_columns_and_a_long_text(spark):
    docs = spark.createDataFrame([(1, "words and 1 more, " * 50_000, 5, "x", 2)], "doc_id bigint, text string, n int, form string, copies int")
    (row,) = fill_in_middle.transformed(docs).collect()
    assert tuple(row) == brute(1, "words and 1 more, " * 50_000)
    assert fill_in_middle.transformed(docs.limit(0)).collect() == []


def test_many_copies_are_cut_once(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit("the same text").alias("text"))
    got = fill_in_middle.transformed(docs).groupBy("doc_id", "output").count().collect()
    assert sorted((r["doc_id"], r["output"], r["count"]) for r in got) == [(i, brute(i, "the same text")[3], 1000) for i in range(3)]


def test_units_stay_where_the_window_puts_them(spark, data):
    made = fill_in_middle.transformed(load(spark, data, "documents"))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("- Exchange hashpartitioning") == 1


def test_query(spark, data):
    assert_same(queries.op11_fill_in_middle(spark, data), queries.OP11_SQL, data)
