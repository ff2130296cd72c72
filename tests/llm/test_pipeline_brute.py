"""The pipeline and the quality verdicts against plain versions of each stage."""

import math
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_duplicates_and_leaks import brute_leaks
from test_near_copies import brute_kept
from tokenizers import Tokenizer

from loomaudit.llm import quality_rules, queries, toxicity
from loomaudit.llm.common import load

LABELLED = "/root/testdata/sf0.01"


def plain_verdict(text, rules):
    """Whether the text passes the base rules and the list, the first rule that holds deciding."""
    c = dict(zip(quality_rules.COUNTS, quality_rules.count_text(text), strict=True))
    if c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]:
        return False
    words, chars, lines = max(c["n_words"], 1), max(c["word_chars"], 1), max(c["n_lines"], 1)
    x = {
        "n_words": c["n_words"], "symbol_share": c["n_symbols"] / chars, "word_length": c["word_chars"] / words, "upper_share": c["n_upper_words"] / words,
        "duplicate_line_share": c["n_dup_lines"] / lines, "repeat_share": c["n_repeat_words"] / words, "distinct_share": c["n_distinct_words"] / words,
    }
    return not any(all(x[n] >= t if up else x[n] < t for n, up, t in r.tests) for r in rules)


def plain_score(text, lexicon):
    total = toxicity.weigh(text or "", toxicity.automaton(lexicon.key()))
    a, b, c = lexicon.curve
    x, y = toxicity.shape(total, len((text or "").split()))
    return 1 / (1 + math.exp(-(a + b * x + c * y)))


def test_quality_verdicts_equal_the_list(spark):
    docs = load(spark, LABELLED, "documents")
    rules = quality_rules.fit(docs, load(spark, LABELLED, "labels"))
    assert rules
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["kept"] for r in queries.op8_quality_rules(spark, LABELLED).collect()} == {i: plain_verdict(t, rules) for i, t in texts.items()}


def test_quality_rules_hold_on_labels_that_they_have_not_seen(spark):
    docs, labels = load(spark, LABELLED, "documents"), load(spark, LABELLED, "labels")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rules = quality_rules.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = [(r["quality"], plain_verdict(texts[r["doc_id"]], rules)) for r in labels.collect() if held(r["doc_id"])]
    assert np.mean([kept for q, kept in seen if q == 1]) > 0.97 and np.mean([kept for q, kept in seen if q == 0]) < 0.3


def test_quality_edges_with_repeated_ids_and_ties(spark):
    rows = [(i, ("good words here and there " * 3 if i % 2 else "# $ % & * < > | # $ % & ") + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    assert quality_rules.fit(docs.union(docs), labels) == rules == quality_rules.fit(docs, labels.union(labels))
    long = spark.createDataFrame([(1, "word " * 300_000)], "doc_id bigint, text string")
    assert quality_rules.judged(long, rules).first()["base_failed"]


def test_pipeline_equals_brute_force(spark):
    docs, labels, benchmark = (load(spark, LABELLED, t) for t in ("documents", "labels", "benchmark"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rules = quality_rules.fit(docs, labels)
    left = {i: t for i, t in texts.items() if plain_verdict(t, rules)}
    lexicon = toxicity.learn_lexicon(docs.where(F.col("doc_id").isin(list(left))), labels)
    left = {i: t for i, t in left.items() if plain_score(t, lexicon) < toxicity.THRESHOLD}
    one_of_each = brute_kept(sorted(left.items()))
    left = {i: t for i, t in left.items() if i in one_of_each}
    leaked = {d for d, _ in brute_leaks(left.items(), [(r["item_id"], r["text"]) for r in benchmark.collect()])}
    left = {i: t for i, t in left.items() if i not in leaked}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, LABELLED).collect()}
    assert set(got) == set(left) and len(left) > 500
    for i, t in left.items():
        assert got[i]["ids"] == library.encode(t, add_special_tokens=False).ids and got[i]["exact"] and got[i]["n_tokens"] == len(got[i]["ids"])


def test_pipeline_with_null_keys_and_an_empty_table(spark, data, tmp_path):
    long = " ".join(f"word{i} follows word{i + 1}." for i in range(4000))
    rows = [(None, long, "en", "s", 1, "x"), (None, long, "en", "s", 1, "y"), (7, None, None, None, None, None), (8, "", "en", "s", 0, "z")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string"
    for name, made in (("rows", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(made, schema).write.parquet(f"file://{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            load(spark, data, table).write.parquet(f"file://{folder}/{table}.parquet")
        got = corpus_pipeline.run(spark, f"file://{folder}").collect()
        assert len(got) == (1 if made else 0)
        assert all(r["doc_id"] is None and r["exact"] for r in got)
