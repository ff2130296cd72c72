import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomaudit.llm import quality_rules, queries, toxicity
from loomaudit.llm.common import load

LABELLED = "/root/testdata/sf0.01"


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


ODD = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 40, "l\nl\n l\n\nl", "é\u00a0ü #|<", "one two three four five six one two three four five", "\x1c\x85 a\u2028b"]


@pytest.mark.parametrize("text", ODD)
def test_counts(text):
    assert quality_rules.count_text(text)[:5] == brute_counts(text)


def test_quality_query(spark, data):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_quality_rules(spark, data).collect()}
    texts = {r["doc_id"]: r["text"] for r in load(spark, data, "documents").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        n, chars, symbols, dup, repeat = brute_counts(text)
        failed = n < 10 or 100 * repeat > 20 * n
        assert got[i][:6] == (n, chars, symbols, dup, repeat, failed)
        assert not (failed and got[i][6])


def test_learned_rules_keep_good_and_reject_bad(spark):
    labels = {r["doc_id"]: r["quality"] for r in load(spark, LABELLED, "labels").collect()}
    out = [r for r in queries.op8_quality_rules(spark, LABELLED).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in out if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in out if labels[r["doc_id"]] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_rules_and_their_expression(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5)
    rules = quality_rules.learn_rules(x, bad)
    held = np.zeros(600, dtype=bool)
    for r in rules:
        held |= quality_rules._covers(r.tests, x)
    assert (held == bad).mean() > 0.97
    df = spark.createDataFrame(list(zip(x["a"].tolist(), x["b"].tolist(), strict=True)), "a double, b double")
    assert [not r["keep"] for r in df.select(quality_rules.verdict(rules, {"a": F.col("a"), "b": F.col("b")}).alias("keep")).collect()] == held.tolist()
    assert quality_rules.learn_rules(x, np.zeros(600, dtype=bool)) == []


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a b c d e f g h i j k", 3)], "doc_id bigint, text string, kept int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    out = quality_rules.judged(docs, rules, "s", "f", "k").collect()
    assert rules == [] and [(r["kept"], r["k"]) for r in out] == [(1, False), (2, False), (3, True)]
    assert quality_rules.judged(docs.limit(0), rules, "s", "f", "k").count() == 0


@pytest.mark.parametrize("text", ["IDIOT", "1d10t", "іdіоt", "id\u200biot", "ｉｄｉｏｔ"])
def test_folding(text):
    assert toxicity.fold(text) == "idiot"


def test_exceptions_and_word_starts():
    lexicon = toxicity.Lexicon({"trash": 2.0})
    found = toxicity.automaton(lexicon.key())
    assert toxicity.weigh(toxicity.fold("you TR4SH!"), found) == 2.0
    assert toxicity.weigh(toxicity.fold("the trash can"), found) == 0
    assert toxicity.weigh(toxicity.fold("untrash"), found) == 0
    assert toxicity.weigh(toxicity.fold("trash can, trash"), found) == 2.0


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in load(spark, "/root/testdata/sf0.1", "labels").collect()}
    out = [r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    hit = [labels[r["doc_id"]] for r in out if r["predicted"] == 1]
    found = [r["predicted"] for r in out if labels[r["doc_id"]] == 1]
    assert np.mean(hit) > 0.85 and np.mean(found) > 0.88
    assert all(0 <= r["score"] <= 1 for r in out)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = (load(spark, LABELLED, t) for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn_lexicon(docs, labels) == toxicity.learn_lexicon(docs, flipped)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "x" * 100_000)], "doc_id bigint, text string")
    lexicon = toxicity.learn_lexicon(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    scores = [r["s"] for r in docs.select(toxicity.score(lexicon, F.col("text")).alias("s")).collect()]
    assert len(scores) == 3 and len(set(scores)) == 1 and scores[0] < toxicity.THRESHOLD
