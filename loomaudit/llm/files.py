"""Files that tasks write and read in the shared folder.

A task writes each file under a name of its own and returns that name; the
names are kept as a table, which Spark commits once for each partition. So a
task that ran twice leaves a file that nothing refers to, and never a wrong one.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from loomaudit.llm.common import new_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, with the scheme of its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, name))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, ending: str) -> str:
    """A path in folder for one attempt of one task."""
    files, path = place(folder)
    files.create_dir(path, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}{ending}"
