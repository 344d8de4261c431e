"""Sinks: manifest files, run datasets and whole-tree snapshots.

File moves happen inside tasks through Arrow file systems, one file per row of a
plan, so a lost task is simply repeated. Only the final directory rename is a
single call from the driver.
"""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.manifests import MANIFEST_NAME, REGISTRY_NAME
from furrow.sources import stores
from furrow.sources.releases import list_files, registry_present
from furrow.sources.stores import open_store, qualify

# Task functions travel with the job: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])
register_pickle_by_value(stores)

_BUFFER = 8 * 1024 * 1024


def _finish(store: fs.FileSystem, part: str, final: str) -> None:
    # Attempts write under their own name, so a repeated task cannot mix contents.
    store.move(part, final)


def _write_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
            store, place = open_store(path)
            store.create_dir(posixpath.dirname(place), recursive=True)
            part = f"{place}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as sink:
                sink.write(text.encode("utf-8"))
            _finish(store, part, place)
        yield batch.select(["path"])


def _copy_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, target in zip(batch["path"].to_pylist(), batch["target"].to_pylist()):
            from_store, from_place = open_store(source)
            to_store, to_place = open_store(target)
            to_store.create_dir(posixpath.dirname(to_place), recursive=True)
            part = f"{to_place}.{uuid.uuid4().hex}"
            with from_store.open_input_stream(from_place) as reader, to_store.open_output_stream(part) as sink:
                while chunk := reader.read(_BUFFER):
                    sink.write(chunk)
            _finish(to_store, part, to_place)
        yield batch.select(["target"])


def write_text_files(texts: DataFrame, root: str) -> int:
    """Write (rel_path, text) rows as UTF-8 files below `root`, each in one move; gives the number written."""
    home = qualify(texts.sparkSession, root)
    placed = texts.select(F.concat(F.lit(home + "/"), "rel_path").alias("path"), "text")
    return placed.mapInArrow(_write_texts, "path string").count()


def write_manifest_files(repaired: DataFrame, release_root: str, document: str = "repaired") -> int:
    """Write one manifest per run below `release_root`; gives the number written.

    The rows must not be read lazily from the files they replace.
    """
    texts = repaired.select(F.concat("run_id", F.lit("/" + MANIFEST_NAME)).alias("rel_path"), F.col(document).alias("text"))
    return write_text_files(texts, release_root)


def write_manifest_dataset(repaired: DataFrame, path: str) -> None:
    """Repaired manifests as a dataset partitioned by run.

    Only the partitions of the runs at hand are replaced.
    """
    (
        repaired.repartition("run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def copy_tree(spark: SparkSession, source: str, target: str, files_per_task: int = 64, bytes_per_task: int = 1 << 30) -> int:
    """Copy every file below `source`; gives the number of files. Raises when the copy differs by name or length."""
    home = qualify(spark, target)
    listing = list_files(spark, source)
    size = listing.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if not size.files:
        return 0
    tasks = max(-(-size.files // files_per_task), -(-int(size.bytes) // bytes_per_task))
    jobs = listing.select("path", F.concat(F.lit(home + "/"), "rel_path").alias("target"))
    jobs.repartition(tasks).mapInArrow(_copy_files, "target string").count()
    copied = list_files(spark, target)
    same = ["rel_path", "length"]
    lost = listing.join(copied, same, "left_anti").select("rel_path").limit(1).collect()
    if lost or copied.count() != size.files:
        raise OSError(f"the copy in {target} differs from {source}" + (f", first at {lost[0].rel_path}" if lost else ""))
    return size.files


def _siblings(spark: SparkSession, target: str) -> tuple:
    """What earlier syncs left beside `target`: the ids of their incoming and outgoing trees and of their seals."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = path(target)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, set[str]] = {kind: set() for kind in ("incoming", "outgoing", "sealed")}
    if store.exists(place.getParent()):
        for status in store.listStatus(place.getParent()):
            for kind, ids in found.items():
                head, mark, number = status.getPath().getName().rpartition(f".{kind}-")
                if mark and head == place.getName():
                    ids.add(number)
    return store, found


def recover_sync(spark: SparkSession, target: str) -> list[str]:
    """Finish or undo a sync of `target` that stopped half-way; what was done, in words.

    A copy that was sealed takes the target's place; one that was not is removed. A tree
    that was set aside comes back when nothing whole can take its place. Running it again
    changes nothing.
    """
    target = target.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store, found = _siblings(spark, target)
    place, done = path(target), []
    for number in sorted(found["sealed"]):
        incoming, outgoing = path(f"{target}.incoming-{number}"), path(f"{target}.outgoing-{number}")
        if number in found["incoming"]:
            _exchange(store, incoming, place, outgoing)
            done.append("finished")
        store.delete(outgoing, True)
        store.delete(path(f"{target}.sealed-{number}"), False)
    for number in sorted(found["incoming"] - found["sealed"]):
        store.delete(path(f"{target}.incoming-{number}"), True)
        done.append("undone")
    for number in sorted(found["outgoing"] - found["sealed"]):
        outgoing = path(f"{target}.outgoing-{number}")
        if store.exists(place):
            store.delete(outgoing, True)
        elif store.rename(outgoing, place):
            done.append("restored")
    return done


def _exchange(store, incoming, place, outgoing) -> None:
    """Set the target aside and put the incoming tree in its place."""
    store.mkdirs(place.getParent())
    if store.exists(place) and not store.rename(place, outgoing):
        raise OSError(f"could not set {place} aside")
    if not store.rename(incoming, place):
        if store.exists(outgoing):
            store.rename(outgoing, place)
        raise OSError(f"could not move {incoming} to {place}")


def sync_release(spark: SparkSession, source: str, target: str, force: bool = False, on_step: Callable[[str], None] = lambda step: None) -> str:
    """Bring a release tree to `target` unless its registry is there; 'kept' or 'replaced'.

    The copy is made next to the target, checked and sealed first, so a bad source leaves
    the old release in place, and the next sync finishes or undoes one that stopped
    anywhere (`recover_sync`). Between the two renames of the exchange the folder is
    missing; readers who cannot bear that use `sources.versions`. One job at a time syncs
    a target. `on_step` is called after 'copied', 'sealed' and 'exchanged'.
    """
    target = target.rstrip("/")
    recover_sync(spark, target)
    if not force and registry_present(spark, target):
        return "kept"
    if list_files(spark, source).isEmpty():
        raise FileNotFoundError(f"no release files below {source}")
    if not registry_present(spark, source):
        raise FileNotFoundError(f"{REGISTRY_NAME} is missing below {source}")
    number = uuid.uuid4().hex
    staging = f"{target}.incoming-{number}"
    copy_tree(spark, source, staging)
    if not registry_present(spark, staging):
        raise FileNotFoundError(f"{REGISTRY_NAME} is missing after the copy to {staging}")
    on_step("copied")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    seal, outgoing = path(f"{target}.sealed-{number}"), path(f"{target}.outgoing-{number}")
    store = seal.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.create(seal, False).close()
    on_step("sealed")
    _exchange(store, path(staging), path(target), outgoing)
    on_step("exchanged")
    store.delete(outgoing, True)
    store.delete(seal, False)
    return "replaced"
