import random
import re

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from loomaudit.llm import common, decontamination, queries, simhash
from loomaudit.llm.common import load


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    """prints: key -> fingerprint; key -> smallest key reachable."""
    owner = {k: k for k in prints}

    def find(k):
        while owner[k] != k:
            k = owner[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                owner[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_query(spark, data):
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in load(spark, data, "documents").collect()}
    want = {k: (f"{prints[k]:016x}", c) for k, c in brute_components(prints).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, data).collect()} == want


@pytest.mark.parametrize("cell", [1, 4, 1000])
@pytest.mark.parametrize("segments", [8, 16])
def test_links_keep_all_connections(spark, cell, segments):
    random.seed(cell)
    words = {0, 2**64 - 1, 1 << 63}
    for _ in range(12):
        centre = random.getrandbits(64)
        words |= {centre, *(centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(15))}
    walk = random.getrandbits(64)
    for _ in range(30):
        walk ^= (1 << random.randrange(64)) | (1 << random.randrange(64))
        words.add(walk)
    signed = {w: w - (1 << 64) if w >> 63 else w for w in words}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp bigint")
    edges = simhash.links(df, segments, cell)
    for r in edges.collect():
        assert r["a"] < r["b"] and ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components({signed[w]: w for w in words})
    assert {k: got.get(k, k) for k in want} == want


def test_simhash_broadcasts_no_table_that_grows(spark, data, monkeypatch):
    """Spark's own bound on broadcasts takes exploded tables for small ones; the plans must not broadcast them, nor the fingerprints, nor many nodes."""
    plans = []

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.written(df, name)

    monkeypatch.setattr(simhash, "written", written)
    docs = load(spark, data, "documents").select("doc_id", "text")
    found = simhash.with_components(docs)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    joins = {name: plan for name, plan in plans if "Join" in plan and not name.startswith("components")}
    assert {"simhash-cells", "simhash-classes", "result"} == set(joins)
    assert not [name for name, plan in joins.items() if "Broadcast" in plan]

    words = [1 << i | 1 << j for i in range(12) for j in range(i)]
    signed = spark.createDataFrame([(w,) for w in words], "fp bigint")
    for cell in (1, 1000):
        plans.clear()
        edges = simhash.links(signed, cell=cell)
        assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    want = {w: 3 for w in words}
    for bound, merges in ((0, True), (1000, False)):
        plans.clear()
        assert {r["node"]: r["root"] for r in simhash.components(edges, broadcast_nodes=bound).collect()} == want
        rounds = [plan for name, plan in plans if name == "components"][1:]
        assert rounds and all(("Broadcast" not in plan) == merges for plan in rounds)


def test_simhash_edges(spark):
    df = spark.createDataFrame([(5, None, "a"), (2, "", "b"), (None, " ", "c"), (9, "one two three four", "d"), (9, "one two three four", "e"), (None, "other words are here now", "f")], "doc_id bigint, text string, fingerprint string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.with_components(df).collect())
    assert got == [("2", "2"), ("5", "2"), ("9", "9"), ("9", "9"), ("None", "2"), ("None", "None")]
    assert simhash.with_components(df.limit(0)).count() == 0


def test_simhash_of_very_long_texts(spark):
    """A text of 300,000 words, one with a word more, and another."""
    long = "some words of a text " * 60_000
    df = spark.createDataFrame([(1, long), (2, long + "end"), (3, "other " * 300_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.with_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def shingles(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
        runs = {tuple(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1)}
        out |= {(d, i) for i, t in items if shingles(t) and len(shingles(t) & runs) >= 0.8 * len(shingles(t))}
    return out


def test_leak_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, data, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in load(spark, data, "benchmark").collect()]
    got = queries.op9_decontamination(spark, data).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def test_partial_leaks(spark):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 5, 6, 12, 40, 70, 200))] + [(90, None), (91, ""), (92, "!!"), (None, "a b c d e"), (93, "x y")]
    docs = []
    for n, (_, text) in enumerate(items[:7]):
        words = text.split()
        for broken in range(0, 4):
            copy = words.copy()
            for _ in range(broken):
                copy[random.randrange(len(copy))] = word()
            docs.append((10 * n + broken, " ".join(word() for _ in range(300)) + " " + ", ".join(copy).upper() + "\n" + " ".join(word() for _ in range(300))))
    docs += [(500, None), (501, ""), (None, items[4][1]), (502, "x y"), (502, "more X-Y here")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    docs.append((None, "they say a b c d e f"))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute_leaks(docs, items)
    assert (None, 4) in want and (None, None) in want
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()} == want and len(want) > 12
    kept = decontamination.without_leaks(d.withColumn("shared", F.lit(1)), b)
    assert kept.columns == ["doc_id", "text", "shared"] and kept.where("doc_id is null").count() == 0 and kept.where("doc_id = 500").count() == 1
    assert decontamination.leaks(d, b.limit(0)).count() == 0 and decontamination.leaks(d.limit(0), b).count() == 0


def test_repeated_ids_lose_no_leak(spark):
    """Two items of one id are two items; two documents of one id are two documents."""
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    items = spark.createDataFrame([(1, one), (1, two), (1, two)], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, "x " + one), (7, "clean words"), (8, two), (8, two), (9, one[:60])], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"], r["shared"]) for r in decontamination.leaks(docs, items).collect()) == [(7, 1, 26), (8, 1, 26)]
    assert sorted(r["text"] for r in decontamination.without_leaks(docs, items).collect()) == ["a0 a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13 a14 a15 a16 a1"[:60], "clean words"]


def test_a_very_long_document(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    item = " ".join(f"w{i}" for i in range(150_000, 150_040))
    got = decontamination.leaks(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), spark.createDataFrame([(2, item)], "item_id bigint, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(1, 2)]


def test_shuffled_join_beyond_the_bound(spark, data, monkeypatch):
    docs, items = load(spark, data, "documents"), load(spark, data, "benchmark")
    small = decontamination.leaks(docs, items).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontamination.leaks(docs, items).collect())) == sorted(map(tuple, small))
