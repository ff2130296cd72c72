"""Benchmark decontamination by size-partitioned MinHash containment search.

An item counts as leaked into a document if at least THRESHOLD of its distinct
word shingles are in the document. Items are partitioned by the size of their
shingle sets (powers of two). A partition keeps of each item the bottom k
hashes, its MinHash sketch: k is the least number for which an item of the
partition's largest size that is contained to THRESHOLD must have one of its k
smallest hashes in the document. So a long document needs no sketch of its own:
its shingle hashes are looked up in the sketches, and no leak is missed at any
ratio of sizes. Each candidate pair is then verified on the shingles themselves.

Words are runs of letters and digits, lower-cased. An item of fewer than WORDS
words is one shingle of all its words. Null or empty items, or items without
words, never match; null texts hold nothing. Every row of the benchmark is an
item of its own and every row of the documents a document, whatever their ids:
repeated and null ids lose no leak. Rows with the same id and text are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomaudit.llm.common import fresh, hinted, small_enough, written

WORDS = 5
THRESHOLD = 0.8
#: Sketch or shingle rows of the benchmark that may be broadcast; beyond, the joins are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(tokens: Column, size: int) -> Column:
    """Where a run of `size` words starts, from 0; none if there are fewer words."""
    return F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(F.array().cast("array<int>"))


def _run(tokens: Column, at: Column, size: int) -> list[Column]:
    return [F.get(tokens, at + k) for k in range(size)]


def shingle_texts(tokens: Column, size: int) -> Column:
    """All runs of `size` words, joined by spaces, repeats included."""
    return F.transform(_places(tokens, size), lambda at: F.concat_ws(" ", *_run(tokens, at, size)))


def shingle_hashes(tokens: Column, size: int) -> Column:
    """A hash of each run of `size` words, without joining them."""
    return F.transform(_places(tokens, size), lambda at: F.xxhash64(*_run(tokens, at, size)))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, item_id, size: words of a shingle, hash, shingle, n: distinct shingles of the item); item tells rows apart."""
    split = items.select(_key("item_id").alias("item"), "item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    sized = split.select("item", "item_id", "w", F.least(F.size("w"), F.lit(WORDS)).alias("size"))
    by_size = [sized.where(F.col("size") == k).select("item", "item_id", "size", F.explode(F.arrays_zip(shingle_hashes(F.col("w"), k).alias("hash"), shingle_texts(F.col("w"), k).alias("shingle"))).alias("s")) for k in range(1, WORDS + 1)]
    made = reduce(DataFrame.unionByName, by_size).select("item", "item_id", "size", "s.*").distinct()
    return made.join(made.groupBy("item").agg(F.count("*").alias("n")), "item")


def sketches(made: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(hash, item) of the bottom-k sketches, k by size partition."""
    largest = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    k = largest - F.ceil(largest * threshold - 1e-9) + 1
    ranked = made.select("item", "hash", k.alias("k"), F.row_number().over(Window.partitionBy("item").orderBy("hash")).alias("rank"))
    return ranked.where("rank <= k").select("hash", "item")


def _exploded(docs: DataFrame, sizes: list[int], of, name: str) -> DataFrame:
    split = docs.select("key", words(F.col("text")).alias("w"))
    return split.select("key", F.explode(F.concat(*(of(F.col("w"), size) for size in sizes))).alias(name))


def _key(name: str) -> Column:
    """What tells rows (name, text) apart: the id and a hash of the text."""
    return F.concat_ws(":", F.col(name).cast("string"), F.hex(F.xxhash64("text")))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(key, item_id, shared, containment) for each document and item leaked into it."""
    return _found(docs.select(F.col(key).alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias(key), "item_id", "shared", "containment")


def _found(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    made = written(item_shingles(items.select("item_id", "text")), "benchmark-shingles")
    sizes = sorted(r["size"] for r in made.select("size").distinct().collect()) or [WORDS]  # at most WORDS of them
    small = small_enough(made, BROADCAST_ROWS)
    keyed = docs.select(_key("doc_id").alias("key"), "doc_id", "text")
    candidates = written(_exploded(keyed, sizes, shingle_hashes, "hash").join(hinted(sketches(made, threshold), small), "hash").select("key", "item").distinct(), "leak-candidates")
    met = written(candidates.select("key").distinct(), "leak-documents")
    searched = keyed.join(hinted(met, small_enough(met, BROADCAST_ROWS)), "key", "left_semi")
    ids = searched.select("key", "doc_id").distinct()
    present = _exploded(searched, sizes, shingle_texts, "shingle").join(hinted(made, small), "shingle").select("key", "item", "item_id", "n", "shingle")
    counted = present.join(candidates, ["key", "item"], "left_semi").groupBy("key", "item", "item_id", "n").agg(F.countDistinct("shingle").alias("shared"))
    leaked = counted.where(F.col("shared") >= threshold * F.col("n") - 1e-9)
    return leaked.join(ids, "key").select("key", "doc_id", "item_id", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without those that an item has leaked into."""
    mark = fresh(docs, "leak_key")
    found = written(_found(docs.select(F.col(key).alias("doc_id"), "text"), items, THRESHOLD).select(F.col("key").alias(mark)).distinct(), "leaked")
    marked = docs.withColumn(mark, F.concat_ws(":", F.col(key).cast("string"), F.hex(F.xxhash64("text"))))
    return marked.join(hinted(found, small_enough(found, BROADCAST_ROWS)), mark, "left_anti").select(*docs.columns)
