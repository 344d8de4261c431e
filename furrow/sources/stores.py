"""File systems for code inside tasks.

Paths are qualified on the driver by Spark's own file systems, so a path without a
scheme means the cluster's default store. Tasks open the store the scheme names and
refuse those they do not know; the local disk is used for `file:` alone.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession

_QUALIFIED = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)$", re.DOTALL)


def qualify(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(place).toString().rstrip("/")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a qualified path."""
    parts = _QUALIFIED.match(path)
    if parts is None:
        raise ValueError(f"not a qualified path: {path}")
    scheme, authority, place = parts.group(1).lower(), parts.group(2) or "", parts.group(3)
    if scheme == "file":
        return fs.LocalFileSystem(), place
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(), authority + place
    if scheme in ("gs", "gcs"):
        return fs.GcsFileSystem(), authority + place
    if scheme in ("hdfs", "viewfs"):
        return fs.HadoopFileSystem.from_uri(f"{scheme}://{authority}"), place
    raise ValueError(f"no file system for {scheme}: in tasks")
