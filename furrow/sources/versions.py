"""Versioned releases: whole trees side by side and one small commit file that says which one counts.

A home folder holds

    versions/<number>-<id>/   a release; it counts for nobody until it is committed
    listings/<number>-<id>/   table of its files with length and SHA-256, from the copy itself
    sealed/<number>-<id>      written once the copy is whole
    commits/<number>          the commit: names the version and carries a checksum

Readers take the highest commit whose checksum holds. A commit appears by one rename, so a
job that stops anywhere leaves readers with the release before or the release after, and
`recover` finishes what was sealed and removes what was not. One job at a time publishes
to a home; a second one that commits the same number fails and leaves the first in force.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.manifests import REGISTRY_NAME
from furrow.session import persist_reliably
from furrow.sources import stores
from furrow.sources.releases import list_files
from furrow.sources.stores import open_store, qualify

# Task functions travel with the job: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])
register_pickle_by_value(stores)

LISTING = "rel_path string, length bigint, sha256 string"
_BUFFER = 8 * 1024 * 1024
STEPS = ("copied", "listed", "sealed", "committed", "pruned")


@dataclass(frozen=True)
class Release:
    """A committed release: its number, version name, folder, and how many files and bytes it has."""

    number: int
    version: str
    path: str
    files: int
    bytes: int


def _copy_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], []]
        for source, target, rel_path in zip(*(batch[c].to_pylist() for c in ("path", "target", "rel_path"))):
            from_store, from_place = open_store(source)
            to_store, to_place = open_store(target)
            to_store.create_dir(posixpath.dirname(to_place), recursive=True)
            # Attempts write under their own name, so a repeated task cannot mix contents.
            part, digest = f"{to_place}.{uuid.uuid4().hex}", hashlib.sha256()
            with from_store.open_input_stream(from_place) as reader, to_store.open_output_stream(part) as sink:
                while chunk := reader.read(_BUFFER):
                    digest.update(chunk)
                    sink.write(chunk)
            to_store.move(part, to_place)
            for column, value in zip(rows, (rel_path, to_store.get_file_info(to_place).size, digest.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], ["rel_path", "length", "sha256"])


class _Home:
    """The few control files of a home, reached from the driver through Spark's file systems."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, qualify(spark, home)
        self.jvm = spark.sparkContext._jvm
        self.store = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        place = self._path(folder)
        if not self.store.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self.store.listStatus(place) if not s.getPath().getName().startswith("."))

    def read(self, name: str) -> dict | None:
        """The content of a control file; None when it is missing, torn or changed."""
        place = self._path(name)
        if not self.store.exists(place):
            return None
        source = self.store.open(place)
        try:
            raw = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()
        try:
            found = json.loads(raw)
            return found["content"] if found["sum"] == _checksum(found["content"]) else None
        except (ValueError, KeyError, TypeError):
            return None

    def write(self, name: str, content: dict) -> None:
        """Write a control file under another name and put it in place by one rename that replaces nothing."""
        place = self._path(name)
        self.store.mkdirs(place.getParent())
        part = self._path(f"{posixpath.dirname(name)}/.{uuid.uuid4().hex}")
        sink = self.store.create(part, False)
        try:
            sink.write(bytearray(json.dumps({"content": content, "sum": _checksum(content)}).encode()))
        finally:
            sink.close()
        if self.store.exists(place) or not self.store.rename(part, place):
            self.store.delete(part, False)
            raise FileExistsError(f"{name} is there already in {self.home}")

    def delete(self, name: str) -> None:
        self.store.delete(self._path(name), True)


def _checksum(content: dict) -> str:
    return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()


def _number_of(name: str) -> int:
    return int(name.split("-")[0])


def _commits(home: _Home) -> list[tuple[int, dict]]:
    """Valid commits, newest first."""
    found = [(_number_of(n), home.read(f"commits/{n}")) for n in home.names("commits")]
    return sorted(((n, c) for n, c in found if c is not None), key=lambda x: -x[0])


def _release(home: _Home, number: int, content: dict) -> Release:
    return Release(number, content["version"], f"{home.home}/versions/{content['version']}", content["files"], content["bytes"])


def current(spark: SparkSession, home: str) -> Release | None:
    """The release in force, or None. Commits that are torn count as not made."""
    place = _Home(spark, home)
    return next((_release(place, n, c) for n, c in _commits(place)), None)


def contents(spark: SparkSession, home: str, release: Release | None = None) -> DataFrame:
    """(rel_path, length, sha256) of a release, by default the one in force; none without a release."""
    release = release or current(spark, home)
    if release is None:
        return spark.createDataFrame([], LISTING)
    return spark.read.schema(LISTING).parquet(f"{qualify(spark, home)}/listings/{release.version}")


def recover(spark: SparkSession, home: str) -> list[str]:
    """Finish or undo what an interrupted job left; what was done, in words, in the order done.

    A sealed version newer than the release in force is committed; versions that were
    never sealed, and sealed ones that a newer release has overtaken, are removed, and so
    are torn commits. Running it again changes nothing.
    """
    place, done = _Home(spark, home), []
    for name in place.names("commits"):
        if place.read(f"commits/{name}") is None:
            place.delete(f"commits/{name}")
            done.append(f"removed torn commit {name}")
    commits = _commits(place)
    newest, committed = (commits[0][0] if commits else 0), {c["version"] for _, c in commits}
    for version in place.names("sealed"):
        seal = place.read(f"sealed/{version}")
        if version not in committed and seal is not None and _number_of(version) > newest:
            place.write(f"commits/{_number_of(version):010d}", seal)
            committed.add(version)
            newest = _number_of(version)
            done.append(f"committed {version}")
    for version in sorted({*place.names("versions"), *place.names("sealed"), *place.names("listings")} - committed):
        _remove(place, version)
        done.append(f"removed {version}")
    return done


def _remove(place: _Home, version: str) -> None:
    # The seal goes first: a half-removed version must never look whole.
    for folder in ("sealed", "listings", "versions"):
        place.delete(f"{folder}/{version}")


def publish(
    spark: SparkSession,
    source: str,
    home: str,
    keep: int = 2,
    files_per_task: int = 64,
    bytes_per_task: int = 1 << 30,
    on_step: Callable[[str], None] = lambda step: None,
) -> Release:
    """Copy the release tree below `source` into `home` and put it in force.

    The source needs its registry file. Every file is copied once, hashed on the way, and
    the copy's own account of names and lengths must equal the source's listing before
    the version is sealed. `keep` releases stay, the one in force included. `on_step` is
    called after each of STEPS.
    """
    if keep < 1:
        raise ValueError("keep at least the release in force")
    recover(spark, home)
    place = _Home(spark, home)
    listing = list_files(spark, source)
    if listing is None or listing.isEmpty():
        raise FileNotFoundError(f"no release files below {source}")
    listing = persist_reliably(listing.select("path", "rel_path", "length"))
    facts = listing.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), F.max(F.col("rel_path") == REGISTRY_NAME).alias("registry")).first()
    if not facts.registry:
        raise FileNotFoundError(f"{REGISTRY_NAME} is missing below {source}")
    commits = _commits(place)
    number = (commits[0][0] if commits else 0) + 1
    version = f"{number:010d}-{uuid.uuid4().hex}"
    tasks = max(-(-facts.n // files_per_task), -(-int(facts.b) // bytes_per_task))
    jobs = listing.select("path", "rel_path", F.concat(F.lit(f"{place.home}/versions/{version}/"), "rel_path").alias("target"))
    copied = jobs.repartition(tasks).mapInArrow(_copy_hashed, LISTING)
    copied.write.parquet(f"{place.home}/listings/{version}")
    on_step("copied")
    written = spark.read.schema(LISTING).parquet(f"{place.home}/listings/{version}")
    same = ["rel_path", "length"]
    lost = listing.join(written, same, "left_anti").select("rel_path").limit(1).collect()
    if lost or written.count() != facts.n:
        _remove(place, version)
        raise OSError(f"the copy of {source} differs" + (f", first at {lost[0].rel_path}" if lost else ""))
    on_step("listed")
    content = {"version": version, "files": facts.n, "bytes": int(facts.b)}
    place.write(f"sealed/{version}", content)
    on_step("sealed")
    place.write(f"commits/{number:010d}", content)
    on_step("committed")
    for old, commit in _commits(place)[keep:]:
        place.delete(f"commits/{old:010d}")
        _remove(place, commit["version"])
    on_step("pruned")
    return _release(place, number, content)
