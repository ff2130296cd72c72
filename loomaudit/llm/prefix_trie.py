"""The trie of conversations' prefixes, built as a Patricia tree.

A node stands for a sequence of first turns that some conversation begins with.
Each prefix has an id that sums hashes of its turns and their places. Distinct
conversations are sorted by their ids, so that those with common turns stand
side by side; how many turns two neighbours share says where paths part. Only
these places, ends and the root become points, joined by edges that skip all
nodes between. Counts are added up over the points by doubling jumps to
ancestors, and nodes between two points follow from the lower one and the
running bytes of its path.

Turns are in the order of `turn` (null first), then role and text; null roles
and texts are empty. Rows without conv_id belong to no conversation and are left
out. Equal conversations are members of the same nodes; a turnless one is a
member of the root alone. An empty table has no nodes. Further columns are not
read. A conversation is one row of 24 bytes a turn while neighbours are
compared: a million turns are 24 MB in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomaudit.llm.common import written

#: A conversation takes over turns of the first of its group of so many ids: at most one less than SHARED.
GROUP, SHARED = 5, 9
#: Ids of conversations that are joined into one string at once.
CHUNK = 4096


def _root() -> Column:
    """The id of the root."""
    return F.lit(b"")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, role, text): the turns of each conversation, numbered from 1."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("bigint").alias("k"), "role", "text")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text): conversation c begins with the first h turns of c - c % GROUP, h = crc32(c) % SHARED, and goes on with its own turns after its first h. A row of depth 0 stands for each conversation. Remainders have the sign of c."""
    own = turns(conversations)
    shares = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")
    sizes = own.groupBy("conv_id").agg(F.max("k").alias("n"))
    plan = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), shares)
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    heads = own.where(F.col("k") < SHARED).select(F.col("conv_id").alias("base"), "k", "role", "text")
    taken = plan.join(heads, "base").where(F.col("k") <= F.col("h")).select("conv_id", F.col("k").alias("depth"), "role", "text")
    kept = own.join(plan.select("conv_id", "h", "taken"), "conv_id").where(F.col("k") > F.col("h")).select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    none = F.lit(None).cast("string")
    return kept.unionByName(taken).unionByName(plan.select("conv_id", F.lit(0).cast("bigint").alias("depth"), none.alias("role"), none.alias("text")))


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, end, path, upto) of rows (conv_id, depth, role, text): the ids of all prefixes, the last of them, and the bytes of text up to each."""
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(F.when(F.col("depth") > 0, F.xxhash64(F.lit(lane), "depth", "role", "text")).otherwise(0).cast("decimal(20,0)")).over(upto) for lane in (1, 2)]
    prefix = F.unhex(F.substr(F.sha2(F.concat_ws("/", *(x.cast("string") for x in sums)), 256), F.lit(1), F.lit(32)))
    read = rows.select("conv_id", "depth", F.when(F.col("depth") > 0, prefix).otherwise(_root()).alias("id"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto).cast("bigint").alias("upto"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "id", "upto"))).alias("turns"))
    below = F.slice("turns", F.lit(2), F.size("turns") - 1)
    return whole.select("conv_id", F.element_at("turns", -1)["id"].alias("end"), F.transform(below, lambda x: x["id"]).alias("path"), F.transform(below, lambda x: x["upto"]).alias("upto"))


def in_order(each: DataFrame) -> DataFrame:
    """(end, path, upto, n, conv_id, shared): distinct paths, how many conversations have them, the smallest of those, and how many turns the path shares with the one before it in order."""
    once = each.groupBy("end").agg(F.first("path").alias("path"), F.first("upto").alias("upto"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    ordered = written(once.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()), "trie-paths")
    # The last path of a part stands in front of the next part; there is one row for each part here.
    lasts = ordered.groupBy("part").agg(F.max("path").alias("path")).select(F.lead("part").over(Window.orderBy("part")).alias("part"), "path")
    both = ordered.unionByName(lasts.where(F.col("part").isNotNull()), allowMissingColumns=True)
    before = F.lag("path").over(Window.partitionBy("part").orderBy("path", F.col("n").isNotNull()))
    # An id stands for all turns up to its own, so equal ids are the common turns.
    return both.withColumn("shared", F.coalesce(F.size(F.array_intersect("path", before)), F.lit(0))).where(F.col("n").isNotNull()).drop("part")


def _at(array: str, depth: Column, root: Column) -> Column:
    return F.when(depth > 0, F.get(array, depth - 1)).otherwise(root)


def edges(ordered: DataFrame) -> DataFrame:
    """(id, depth, upto, parent, top, top_upto, owner): each point but the root, with the point above it and the path on which it comes first. A path has its own points behind what it shares with the one before."""
    points = ordered.select(F.explode(F.array("end", _at("path", F.col("shared"), _root()))).alias("id")).distinct()
    start = F.struct(F.col("shared").cast("bigint").alias("depth"), _at("path", F.col("shared"), _root()).alias("id"), _at("upto", F.col("shared"), F.lit(0)).alias("upto"))
    own = F.slice(F.transform("path", lambda x, i: F.struct((i + 1).cast("bigint").alias("depth"), x.alias("id"), F.get("upto", i).alias("upto"))), F.col("shared") + 1, F.size("path"))
    owned = ordered.select(F.col("end").alias("owner"), start.alias("start"), F.explode(own).alias("node")).select("owner", "start", "node.*")
    found = owned.join(points, "id")
    above = F.coalesce(F.lag(F.struct("depth", "id", "upto")).over(Window.partitionBy("owner").orderBy("depth")), F.col("start"))
    return found.withColumn("above", above).select("id", "depth", "upto", F.col("above.id").alias("parent"), F.col("above.depth").alias("top"), F.col("above.upto").alias("top_upto"), "owner")


def totals(ordered: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, n, conv_id, leaves, weight, skipped, children) of each point over all points below it and itself: members, the smallest, leaves, the bytes of all members' texts, the bytes on edges, and its own children."""
    children = joined.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    root = ordered.limit(1).select(_root().alias("id"), F.lit(None).cast("binary").alias("jump"), F.lit(0).cast("bigint").alias("skipped"))
    points = joined.select("id", F.col("parent").alias("jump"), (F.col("upto") - F.col("top_upto")).alias("skipped")).unionByName(root)
    ends = ordered.select(F.col("end").alias("id"), "n", "conv_id", (F.col("n") * F.coalesce(F.get("upto", F.size("upto") - 1), F.lit(0))).alias("weight"))
    state = points.join(children, "id", "left").join(ends, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n", "weight", "children")}
    state = written(state.withColumns(zero).withColumn("leaves", (F.col("children") == 0).cast("bigint")), "trie-points")
    sums = ("n", "leaves", "weight", "skipped")
    while not state.where(F.col("jump").isNotNull()).isEmpty():
        # Each point holds what is less than 2^k edges below it; the point 2^k edges above takes that over.
        gained = state.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("id")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums), F.min("conv_id").alias("least"))
        more = state.join(gained, "id", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in sums} | {"conv_id": F.least("conv_id", "least")})
        further = state.where(F.col("jump").isNotNull()).select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        state = written(more.join(further, "jump", "left").select("id", F.col("next").alias("jump"), *sums, "conv_id", "children"), "trie-points")
    return state.drop("jump")


def ends(each: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the ids, ascending and joined by commas, of the conversations that end at a point.

    The ids of a point, however many, are joined in parts of a sort and hashed part by part: a task holds one part at a time. A hash of one string is one task's work."""
    ranged = each.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            found = [(end, [c for _, c in group]) for end, group in groupby(rows, lambda x: x[0])]
            parts = [(end, ids[i], ",".join(map(str, ids[i : i + CHUNK]))) for end, ids in found for i in range(0, len(ids), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["id", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["id", "ends_sha256"])

        current, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for id_, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if id_ == current:
                    digest.update(b"," + part.encode())
                    continue
                if current is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = id_, hashlib.sha256(part.encode())
            yield made(done)
        if current is not None:
            yield made([(current, digest.hexdigest())])

    parts = ranged.mapInArrow(joined, "id binary, first bigint, ids string")
    return parts.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashed, "id binary, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node of conversations (conv_id, depth, role, text), see `rebuilt`.

    conv_id is the smallest member; saved_tokens are the bytes of the last texts of all nodes below and its own, times their members less one."""
    each = written(paths(rows), "trie-conversations")
    ordered = written(in_order(each), "trie-ordered")
    joined = written(edges(ordered), "trie-edges")
    known = totals(ordered, joined)
    above = known.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    routes = ordered.select(F.col("end").alias("owner"), F.col("upto").alias("bytes"))
    points = known.join(joined, "id", "left").join(above, "parent", "left").join(routes, "owner", "left").join(ends(each), "id", "left")
    # Upward from a point along its edge: nodes between are like it but for their one child and the bytes from there on.
    depth, top = F.coalesce("depth", F.lit(0)), F.coalesce("top", F.lit(-1))
    upto = F.coalesce("upto", F.lit(0))
    edge = F.coalesce(F.col("upto") - F.col("top_upto"), F.lit(0))
    below = F.col("weight") - F.col("n") * upto - (F.col("skipped") - edge)
    each_node = points.select("*", below.alias("below"), upto.alias("end_upto"), depth.cast("bigint").alias("end_depth"), F.explode(F.sequence(top + 1, depth)).alias("node_depth"), top.alias("over"))
    here = F.col("node_depth") == F.col("end_depth")
    before = F.when(F.col("node_depth") > 0, F.coalesce(F.get("bytes", F.col("node_depth").cast("int") - 2), F.lit(0))).otherwise(0)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return each_node.select(
        "conv_id", F.col("node_depth").cast("bigint").alias("depth"), F.when(F.col("node_depth") == F.col("over") + 1, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(here, F.col("children")).otherwise(F.lit(1).cast("bigint")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("end_upto") - before)).alias("saved_tokens"), F.when(here, F.coalesce("ends_sha256", empty)).otherwise(empty).alias("ends_sha256"),
    )
