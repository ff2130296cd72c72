"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table of a scale folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomaudit-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs a reread, not a rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, in any case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, the same ones on every run: those with the smallest hash of key. Null keys are left out."""
    return df.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key, F.lit(17)), key).limit(most)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """df to be broadcast where its size was checked, else left to a shuffled join."""
    return F.broadcast(df) if small else df


def crc_bucket(key: Column, buckets: int = 4) -> Column:
    """crc32 of the key as text, modulo buckets; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % buckets


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0
