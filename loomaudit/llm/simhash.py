"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to the counts of set bits in its segments. The
Manhattan distance of two such vectors never exceeds the number of differing
bits. So the pairs within 2 bits are among those whose vectors lie within 2,
and two lattice points within 2 always share a lattice point within 1 of both.
That makes the range join an equi-join: each distinct fingerprint goes to the
cell of its vector and of the vectors one step away; pairs in a cell are
verified on the bits. A cell with more than CELL fingerprints is not paired
off: its fingerprints go on to the words within one bit of them. Fingerprints
that meet at such a word differ in at most 2 bits, and those that differ in at
most 2 bits meet at one, so a link from each to the smallest at the word keeps
every link's connection without pairs.

Exact copies have one fingerprint and count once. Components come from rounds
of hooking to the smallest neighbour with pointer jumping, over tables in the
shared folder. Spark takes an exploded table for as small as the one before it,
so joins whose tables grow with the input ask for a merge: none of them is
broadcast, which would bring it through the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.llm.common import small_enough, written

SEED = 42
SEGMENTS = 16
#: Fingerprints of a cell that are paired off; larger cells take the exact way without pairs.
CELL = 32
#: Nodes of linked fingerprints up to which a round of the components may broadcast them.
BROADCAST_NODES = 100_000


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text: A-Z lower-cased, shingles of `words` words, repeats included; a bit is set if it is in over half the shingles. No words: 0."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    shingles = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """The fingerprints of a column, as signed 64-bit integers."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(x.as_py(), words) for x in column], dtype=np.uint64).view(np.int64))

    return F.arrow_udf(run, "bigint")(text)


def as_hex(fingerprint: Column) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def cells(fingerprint: Column, segments: int = SEGMENTS) -> Column:
    """The cells of a fingerprint: its vector of popcounts and those one step away, each as one integer with a digit per segment."""
    width = 64 // segments
    base = width + 1
    if base**segments > 2**63:
        raise ValueError("so many segments don't fit in a 64-bit cell number")
    counts = [F.bit_count(F.shiftrightunsigned(fingerprint, i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("bigint") for i in range(segments)]
    own = reduce(lambda a, b: a + b, [c * F.lit(base**i) for i, c in enumerate(counts)])
    steps = [F.when(c < width, own + F.lit(base**i)) for i, c in enumerate(counts)] + [F.when(c > 0, own - F.lit(base**i)) for i, c in enumerate(counts)]
    return F.array_compact(F.array(own, *steps))


def links(distinct: DataFrame, segments: int = SEGMENTS, cell: int = CELL) -> DataFrame:
    """Edges (a, b), a < b, among distinct fingerprints (fp), that connect what the pairs within 2 bits connect; every edge is such a pair."""
    # A table of fingerprints is small to read and large to expand: it is dealt to many tasks before that.
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = distinct.select("fp", F.explode(cells(F.col("fp"), segments)).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(placed.hint("merge").join(sizes, "cell"), "simhash-cells")
    few = shared.where(F.col("size") <= cell)
    pairs = few.select("cell", F.col("fp").alias("a")).hint("merge").join(few.select("cell", F.col("fp").alias("b")), "cell").where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    crowded = shared.where(F.col("size") > cell).select("fp").distinct()
    bits = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)))
    meets = crowded.select("fp", F.explode(bits).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("word"))
    least = meets.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    stars = meets.hint("merge").join(least, "word").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 64, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node that can be reached.

    Each round points every node to the smallest root around it, then to its
    root's root; the rounds grow with the logarithm of the longest path at
    best, and stop when no root changes. Nodes without edges are not listed. Tables
    of more than broadcast_nodes nodes are not broadcast for the small files they
    make."""
    around = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))), "components-edges")
    roots = written(around.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "components")
    # The nodes stay the same; joins with them, planned by the sizes of files, are told to merge. The others are planned by what was shuffled.
    few = small_enough(roots, broadcast_nodes)
    for _ in range(most_rounds):
        known = roots if few else roots.hint("merge")
        seen = around.join(known.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other")
        hooks = seen.join(known, "node").groupBy("node", "root").agg(F.min("seen").alias("seen"))
        lower = hooks.select("node", "root", F.least("root", "seen").alias("low"))
        # A root takes the lowest root that any of its nodes has seen, and its nodes follow it.
        pulled = lower.groupBy("root").agg(F.min("low").alias("pull"))
        moved = lower.join(pulled, "root").select("node", F.col("root").alias("before"), F.col("pull").alias("root"))
        up = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = written(moved.join(up, "root", "left").select("node", "before", F.coalesce("up", "root").alias("root")), "components")
        if after.where("root <> before").isEmpty():
            return after.select("node", "root")
        roots = after.select("node", "root")
    raise RuntimeError("components did not settle")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fingerprint in prints (fp): fingerprints of one component have one root."""
    distinct = written(prints.select("fp").distinct(), "simhash-distinct")
    joined = components(links(distinct)).withColumnRenamed("node", "fp").hint("merge")
    return written(distinct.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-classes")


def with_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, fingerprint: str = "fingerprint", component: str = "component_id") -> DataFrame:
    """(key, fingerprint as an integer, component): component is the smallest key among the documents that links reach. Null and empty texts have fingerprint 0 and are linked like any other. Repeated keys are kept; a null key names no component, and a component without any key has a null name."""
    prints = written(docs.select(F.col(key).alias("id"), fingerprints(F.col(text), words).alias("fp")), "simhash")
    found = classes(prints)
    least = prints.groupBy("fp").agg(F.min("id").alias("id")).hint("merge").join(found, "fp")
    owners = least.groupBy("root").agg(F.min("id").alias("owner"))
    owned = found.hint("merge").join(owners, "root").select("fp", "owner")
    return prints.hint("merge").join(owned, "fp").select(F.col("id").alias(key), F.col("fp").alias(fingerprint), F.col("owner").alias(component))
