"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of THRESHOLD or more.

Exact copies are grouped first. Fingerprints of five words then go through the
grid of `simhash`; what it links is verified on the words and gives the first
links. An edited copy mostly differs in more bits than a grid can reach, so the
search goes on, exactly, by shared rare shingles: shingles have one order for
all texts, the rarer first by a sample, then by hash, and two similar texts
share at least one among the first n - ceil(0.8 n) + 1 of their n (the prefix
filter). Each text goes to the cells of these shingles only. The order decides
the cost, never the result.

No cell is paired off. For some rounds the texts of a cell are held against one
leader, and texts that already are in one component need no more comparison.
What is left, pairs of different components of a cell, is compared in blocks,
so that no connection is lost.

Words are split at white space, A-Z lower-cased, as for fingerprints. A text of
fewer than WORDS words is one shingle; texts without words, nulls among them,
are copies of each other. Extra columns and repeated keys pass through; an
empty table stays empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.llm.common import fresh, hinted, small_enough, written
from loomaudit.llm import simhash
from loomaudit.llm.simhash import components

WORDS = 5
#: The threshold as a fraction, so that no rounding decides.
ABOVE, BELOW = 4, 5
#: Rounds in which the texts of a cell are held against one leader.
ROUNDS = 3
#: Texts of a cell in a block of the comparison that is left.
BLOCK = 512
#: One text in SAMPLE, MOST_SAMPLED at most, is read for the order; shingles count as common from COMMON texts of the sample, MOST_COMMON of them at most.
SAMPLE, MOST_SAMPLED, COMMON, MOST_COMMON = 8, 1_000_000, 8, 50_000
#: Ids that may be broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 200_000
KNOWN_WORDS = 50_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


_HASHES = _Hashes()


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None) -> frozenset[tuple[bytes, ...]]:
    """The distinct shingles of a text; of one without words, the empty one."""
    tokens = _words(text)
    return frozenset(zip(*(tokens[i:] for i in range(WORDS)), strict=False)) if len(tokens) >= WORDS else frozenset([tuple(tokens)])


def shingle_hashes(text: str | None) -> np.ndarray:
    """The hashes of the distinct shingles, sorted."""
    tokens = _words(text)
    width = min(WORDS, len(tokens))
    hashes = np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    mixed = np.full(max(len(tokens) - width + 1, 1) if width else 1, width, dtype=np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(mixed)]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def common_shingles(unique: DataFrame, row: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample, sorted, and in how many texts each was seen."""
    hashes = F.arrow_udf(lambda column: _lists([shingle_hashes(x.as_py()) for x in column]), "array<bigint>")
    step = max(SAMPLE, -(-unique.count() // MOST_SAMPLED))
    sample = unique.where(F.pmod(F.xxhash64(row), F.lit(step)) == 0).select(F.explode(hashes(F.col(text))).alias("cell"))
    seen = sample.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "cell").limit(MOST_COMMON).collect()
    found = np.array([r["cell"] for r in seen], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["n"] for r in seen], dtype=np.int64)[order]


def prefixes(text: Column, common: np.ndarray, seen: np.ndarray) -> Column:
    """struct<n: distinct shingles, cells: the first of them in the order, as many as two similar texts need to meet>."""

    def run(column: pa.Array) -> pa.Array:
        sizes, cells = [], []
        for x in column:
            own = shingle_hashes(x.as_py())
            n = len(own)
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                own = own[np.lexsort((own, np.where(common[at] == own, seen[at], 0)))]
            sizes.append(n)
            cells.append(own[: n - (ABOVE * n + BELOW - 1) // BELOW + 1])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), _lists(cells)], ["n", "cells"])

    return F.arrow_udf(run, "struct<n: int, cells: array<bigint>>")(text)


@lru_cache(maxsize=4)
def _cached(text: str | None) -> frozenset[tuple[bytes, ...]]:
    return shingles(text)


def similar(a: str | None, b: str | None) -> bool:
    x, y = _cached(a), _cached(b)
    shared = len(x & y)
    return BELOW * shared >= ABOVE * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts (id, text) are similar, as a table in the shared folder."""
    pairs = written(pairs, "near-pairs")
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
    involved = texts.join(hinted(ids, small_enough(ids, BROADCAST_IDS)), "id", "left_semi")
    both = pairs.join(involved.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(involved.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    check = F.arrow_udf(lambda a, b: pa.array([similar(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_()), "boolean")
    return written(both.where(check("text_a", "text_b")).select("a", "b"), "near-links")


#: Whether two texts of a cell, of n and m shingles, at places i and j of their orders, can be similar if this is the first shingle that they share.
_LENGTHS = f"{BELOW} * least(n, m) >= {ABOVE} * greatest(n, m)"
_PLACES = f"{ABOVE + BELOW} * least(n - i, m - j) >= {ABOVE} * (n + m)"


def _sides(placed: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    left = placed.select("cell", *more, F.col("id").alias("a"), "n", "i")
    return left, placed.select("cell", *more, F.col("id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))


def first_links(texts: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of texts (id, text) from the grid of fingerprints: each text with the first of its fingerprint, and the first ones of linked fingerprints."""
    prints = written(texts.select("id", simhash.fingerprints(F.col("text"), WORDS).alias("fp")), "near-prints")
    first = prints.groupBy("fp").agg(F.min("id").alias("first"))
    own = prints.join(first, "fp").where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b"))
    edges = simhash.links(written(first.select("fp"), "near-distinct"))
    ends = edges.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return verified(own.unionByName(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), texts)


def links(unique: DataFrame, row: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) among the rows of unique, each a verified pair, that connect what all similar pairs connect."""
    texts = unique.select(F.col(row).alias("id"), F.col(text).alias("text"))
    made = prefixes(F.col("text"), *common_shingles(unique, row, text))
    cells = written(texts.select("id", made.alias("made")).select("id", "made.*"), "near-prefixes")
    sizes = cells.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    met = cells.select("id", "n", F.posexplode("cells").alias("i", "cell")).join(sizes, "cell")
    shared = written(met.withColumn("degree", F.expr("count(*) over (partition by id)")), "near-cells")
    edges = first_links(texts)
    for turn in range(rounds + 1):
        left_over = _open(shared, edges)
        if left_over.isEmpty():
            break
        edges = edges.unionByName(verified(_against_leaders(left_over, turn) if turn < rounds else _across(left_over), texts))
    return edges


def _open(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of those cells that hold more than one component, with their component."""
    known = components(edges).select(F.col("node").alias("id"), "root")
    labelled = shared.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = labelled.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    return written(labelled.join(several, "cell"), "near-open")


def _against_leaders(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs of each text and the leader of its cell. At first that is the text that meets others in the most cells, as one does whose edited copies the others are; then the one with the least hash. Cells with the same texts agree on it."""
    first = F.negative("degree") if turn == 0 else F.lit(0)
    leaders = placed.groupBy("cell").agg(F.min(F.struct(first.alias("first"), F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("leader"), F.col("n").alias("m"), F.col("root").alias("led"))).alias("l")).select("cell", "l.leader", "l.m", "l.led")
    return placed.join(leaders, "cell").where("root <> led").where(_LENGTHS).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _across(placed: DataFrame) -> DataFrame:
    """All pairs of different components of a cell, in blocks."""
    blocks = placed.withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    left = _sides(blocks.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), "root", "block")[0]
    right = _sides(blocks.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumnRenamed("root", "other"), "other", "block")[1]
    return left.join(right, ["cell", "block"]).where("a < b and root <> other").where(_LENGTHS).where(_PLACES).select("a", "b").distinct()


def _named(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: of each component of similar texts one row stays, that with the smallest key; rows without a key come last, and among equal keys any one stays."""
    row = fresh(docs, "near_row")
    copy = F.arrow_udf(lambda column: pa.array([xxhash.xxh3_128_digest(b" ".join(_words(x.as_py()))) for x in column], pa.binary()), "binary")
    rank = F.struct(F.col(key).isNull(), F.col(key))
    first = docs.select(copy(text).alias("copy"), F.struct(*_named(docs)).alias("doc"), rank.alias("rank")).groupBy("copy").agg(F.min_by("doc", "rank").alias("doc"))
    unique = written(first.select("doc.*").withColumn(row, F.monotonically_increasing_id()), "near-unique")
    grouped = components(links(unique, row, text)).select(F.col("node").alias(row), "root")
    ranked = unique.select(row, F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("key"), F.col(row).alias("row")).alias("rank")).join(grouped, row)
    kept = ranked.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    dropped = written(grouped.select(row).join(kept, row, "left_anti"), "near-dropped")
    return unique.join(hinted(dropped, small_enough(dropped, BROADCAST_IDS)), row, "left_anti").select(*_named(docs))
