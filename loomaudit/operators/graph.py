"""Connected components of declared links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where none may be set, one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomaudit-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what several steps read: later plans start at it and read only its columns."""
    path = f"{_shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the smallest node that can be reached. Each round a node takes the smallest root around it, then that root's own."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        seen = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        low = roots.join(seen, "node").select("node", F.col("root").alias("before"), F.least("root", "low").alias("low"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("up"))
        after = cut(low.join(jump, "low").select("node", "before", F.least("low", "up").alias("root")))
        roots = after.select("node", "root")
        if after.where("root <> before").isEmpty():
            return roots
    raise RuntimeError("components did not settle")
