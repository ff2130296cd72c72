"""Generated files that are rewritten only where what they are made of has changed.

A manifest beside the files, a table of versions, says from which inputs each
file was made. A run compares, writes what is stale or absent in tasks, and
commits one new version of the manifest at its end: a run that fails leaves the
old one, so its files are written again. Content follows from the inputs, so a
task that runs twice writes the same file twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.operators.graph import stored

ABSENT, STALE, UNCHANGED, WRITTEN = "absent", "stale", "unchanged", "written"
_VERSION = re.compile(r"v(\d{8})$")


def fingerprint(*inputs: Column) -> Column:
    """SHA-256 of inputs in order, each ended by a NUL, so that no two lists of inputs run together; nulls are empty."""
    ended = F.concat(*(F.concat(F.coalesce(x.cast("binary"), F.lit(b"")), F.lit(b"\0")) for x in inputs))
    return F.sha2(ended, 256)


def _files(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def _versions(root: str) -> list[str]:
    """The committed versions of the manifest, the latest last."""
    system, base = _files(root)
    found = system.get_file_info(fs.FileSelector(f"{base}/_manifest", allow_not_found=True))
    names = sorted(x.base_name for x in found if x.type == fs.FileType.Directory and _VERSION.match(x.base_name))
    return [n for n in names if system.get_file_info(f"{base}/_manifest/{n}/_SUCCESS").type == fs.FileType.File]


def states(wanted: DataFrame, root: str) -> DataFrame:
    """wanted (path, fingerprint, ...) with `status`: absent, stale or unchanged, by the manifest and by which files are there."""
    spark, versions = wanted.sparkSession, _versions(root)
    known = spark.read.parquet(f"{root}/_manifest/{versions[-1]}") if versions else spark.createDataFrame([], "path string, fingerprint string")
    both = wanted.join(known.select("path", F.col("fingerprint").alias("_recorded")), "path", "left")

    def there(column: pa.Array) -> pa.Array:
        system, base = _files(root)
        return pa.array([x.type == fs.FileType.File for x in system.get_file_info([f"{base}/{p.as_py()}" for p in column])], pa.bool_())

    present = F.arrow_udf(there, "boolean")(F.col("path"))
    return both.withColumn("status", F.when(~present, ABSENT).when(F.col("_recorded").eqNullSafe(F.col("fingerprint")), UNCHANGED).otherwise(STALE)).drop("_recorded")


def write(wanted: DataFrame, root: str, render: Callable[[DataFrame], DataFrame], check: bool = False) -> DataFrame:
    """(path, status) of wanted (path below root, fingerprint, ...). What is absent or stale is rendered, by `render` giving the rows a `body` of bytes, and written; with `check`, nothing is. Raises ValueError where nothing is wanted or a path occurs twice."""
    if wanted.isEmpty():
        raise ValueError("no artefacts to write")
    if (twice := wanted.groupBy("path").count().where("count > 1").first()) is not None:
        raise ValueError(f"{twice['path']} is wanted {twice['count']} times")
    told = states(wanted, root)
    if check:
        return told.select("path", "status")
    told = stored(told, "artefacts")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _files(root)
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                name = f"{base}/{path}"
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write(body or b"")
            yield batch.select(["path", "fingerprint"])

    due = told.where(F.col("status") != UNCHANGED)
    if due.isEmpty():
        return told.select("path", "status")
    made = render(due).select("path", "fingerprint", F.col("body").cast("binary").alias("body")).mapInArrow(put, "path string, fingerprint string")
    kept = told.where(F.col("status") == UNCHANGED).select("path", "fingerprint")
    latest = _versions(root)
    version = int(_VERSION.match(latest[-1])[1]) + 1 if latest else 1
    made.unionByName(kept).write.mode("overwrite").parquet(f"{root}/_manifest/v{version:08d}")
    return told.select("path", F.when(F.col("status") == UNCHANGED, UNCHANGED).otherwise(WRITTEN).alias("status"))
