"""Scans of a release tree: one directory per run below a root.

Folders are listed in tasks, one level of the tree per job, so neither the driver nor a
name filter stands between a file and the listing: hidden and empty files count.
"""

from __future__ import annotations

import posixpath
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.manifests import MANIFEST_NAME, REGISTRY_NAME
from furrow.session import persist_reliably
from furrow.sources import stores
from furrow.sources.stores import open_store, qualify

# Task functions travel with the job: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])
register_pickle_by_value(stores)

_ENTRIES = "path string, rel_path string, folder boolean, length bigint, modificationTime timestamp"


def _list_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "rel_path": pa.string(), "folder": pa.bool_(), "length": pa.int64(), "modificationTime": pa.timestamp("us", "UTC")}
    for batch in batches:
        for path, above in zip(batch["path"].to_pylist(), batch["rel_path"].to_pylist()):
            store, place = open_store(path)
            rows: dict[str, list] = {k: [] for k in kinds}
            for entry in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                folder = entry.type == fs.FileType.Directory
                values = (f"{path.rstrip('/')}/{entry.base_name}", posixpath.join(above, entry.base_name), folder, None if folder else entry.size, entry.mtime)
                for column, value in zip(rows.values(), values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in rows.items()], list(kinds))


def _level(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """What lies directly in the folders, each listed by one task's turn."""
    tasks = max(1, min(spark.sparkContext.defaultParallelism * 8, -(-folders.count() // 16)))
    return persist_reliably(folders.select("path", "rel_path").repartition(tasks).mapInArrow(_list_level, _ENTRIES))


def _top(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(qualify(spark, root), "")], "path string, rel_path string")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, length, modificationTime) of all files below a root; contents stay unread.

    One job per level of the tree. A missing root gives no rows.
    """
    found, folders = None, _top(spark, root)
    while not folders.isEmpty():
        level = _level(spark, folders)
        files = level.filter(~F.col("folder")).drop("folder")
        found = files if found is None else found.unionByName(files)
        folders = level.filter("folder")
    return found


def _read_manifest(name: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for path, run in zip(batch["path"].to_pylist(), batch["rel_path"].to_pylist()):
                store, place = open_store(f"{path}/{name}")
                if store.get_file_info(place).type == fs.FileType.File:
                    with store.open_input_stream(place) as source:
                        content = source.read()
                    try:
                        text = content.decode("utf-8")
                    except UnicodeDecodeError:
                        text = None
                    for column, value in zip(rows, (run, f"{path}/{name}", text, path)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.string()) for r in rows], ["run_id", "path", "document", "run_dir"])

    return read


def scan_manifests(spark: SparkSession, release_root: str) -> DataFrame:
    """(run_id, path, document, run_dir) of every run directory that holds a manifest.

    A document that is not valid UTF-8 is null. A missing root gives no rows. The files
    are read when the result is.
    """
    runs = _level(spark, _top(spark, release_root)).filter("folder").select("path", "rel_path")
    tasks = max(1, min(spark.sparkContext.defaultParallelism * 8, -(-runs.count() // 64)))
    return runs.repartition(tasks).mapInArrow(_read_manifest(MANIFEST_NAME), "run_id string, path string, document string, run_dir string")


def run_files(listing: DataFrame) -> DataFrame:
    """Listing split into run and path below the run; files at the root belong to no run."""
    return (
        listing.filter(F.contains("rel_path", F.lit("/")))
        .withColumn("run_id", F.substring_index("rel_path", "/", 1))
        .withColumn("rel_path", F.substring(F.col("rel_path"), F.length("run_id") + 2, F.length("rel_path")))
    )


def existing_paths(listing: DataFrame) -> DataFrame:
    """Distinct paths that exist: every file and every directory above it."""
    parts = F.split("rel_path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return listing.select(F.explode(heads).alias("rel_path")).distinct()


def registry_present(spark: SparkSession, root: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(qualify(spark, f"{root.rstrip('/')}/{REGISTRY_NAME}"))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
