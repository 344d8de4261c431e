"""Centroid clustering of whole-number vectors with geometric drift tightening.

Every vector keeps an upper bound on the distance to its own centroid and a lower bound
on the distance to all others. When centroids move, the lower bound of a cluster's
vectors need not fall by the full drift of a centroid: all of them lie in a sphere, and
in the plane through its centre and the centroid's old and new place the drift seen from
that sphere is at most the drift times the cosine of the smallest angle between the
sphere and the direction of the move, taken from the middle of the move. Vectors whose
bounds still tell their centroid stay; the ambiguous ones are compared with every
centroid exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import persist_reliably

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
DIMENSIONS = 64
SEED = 1
# Larger components would give squared distances beyond a long.
LARGEST = 1 << 27
# Bounds are trusted only beyond this relative error of floating point.
SLACK = 1e-9

_STATE = "vec_id long, code array<int>, cluster int, upper double, lower double, scanned boolean, distance long"


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dimensions)


def _coder(scale: int, dimensions: int) -> Callable:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.floor(scale * _matrix(batch["embedding"], dimensions)).astype(np.int32)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.ListArray.from_arrays(ends, pa.array(whole.ravel()))], ["vec_id", "code"])

    return code


def _usable(vector: Column, scale: int, dimensions: int) -> Column:
    """Exactly `dimensions` components, none null, not a number or too large."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST / scale)))
    return vector.isNotNull() & (F.size(vector) == dimensions) & fits


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows from all centroids."""
    largest = max((int(np.abs(a).max()) for a in (x, centroids) if a.size), default=0)
    if 4 * x.shape[1] * (largest + 1) ** 2 < 1 << 52:
        # Every sum of the products is a whole number that a double holds.
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def _two_nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the smaller number on ties), its squared distance and the next distance."""
    found = squared(x, centroids)
    nearest = found.argmin(1)
    own = found[np.arange(len(x)), nearest]
    if len(centroids) == 1:
        return nearest, own, np.full(len(x), np.inf)
    return nearest, own, np.sqrt(np.partition(found, 1, axis=1)[:, 1].astype(float))


def seen_drift(old: np.ndarray, new: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each sphere (row) and centroid (column): how much nearer the centroid can have come to a place in the sphere.

    From the middle of the move the sphere's centre stands at an angle to the direction
    of the move, and the sphere covers an angle around that. Along any ray from the
    middle the two ends of the move differ in distance by at most the drift times the
    cosine of the ray's angle.
    """
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    from_middle = centres[:, None, :] - (old + new)[None] / 2
    reach = np.sqrt((from_middle * from_middle).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        along = np.clip((from_middle * move[None]).sum(2) / (reach * drift), -1, 1)
        covered = np.arcsin(np.clip(radii[:, None] / reach, 0, 1))
        angle = np.maximum(np.arccos(along) - covered, 0)
    inside = (reach <= radii[:, None]) | ~np.isfinite(angle)
    return drift * np.where(inside, 1.0, np.maximum(np.cos(angle), 0)) * (1 + SLACK)


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster the most that any other centroid can have come nearer to its vectors."""
    seen = seen_drift(old.astype(float), new.astype(float), old.astype(float), radii)
    np.fill_diagonal(seen, 0)
    return seen.max(1, initial=0)


def _starter(centroids: np.ndarray) -> Callable:
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, own, second = _two_nearest(_matrix(batch["code"], centroids.shape[1]).astype(np.int64), centroids)
            yield _state(batch, nearest, np.sqrt(own.astype(float)), second, np.ones(len(batch), bool), own)

    return start


def _state(batch: pa.RecordBatch, cluster, upper, lower, scanned, distance) -> pa.RecordBatch:
    columns = [pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned), pa.array(distance)]
    return pa.RecordBatch.from_arrays([batch["vec_id"], batch["code"], *columns], ["vec_id", "code", "cluster", "upper", "lower", "scanned", "distance"])


def _tightener(centroids: np.ndarray, drift: np.ndarray, loose: np.ndarray) -> Callable:
    gaps = squared(centroids, centroids).astype(float)
    np.fill_diagonal(gaps, np.inf)
    # Within half the way to the next centroid no other one can be nearer.
    half = np.sqrt(gaps.min(1)) / 2

    def tighten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["code"], centroids.shape[1]).astype(np.int64)
            cluster = batch["cluster"].to_numpy().astype(np.int64)
            lower = batch["lower"].to_numpy() - loose[cluster]
            certain = np.maximum(lower, half[cluster]) * (1 - SLACK)
            upper = batch["upper"].to_numpy() + drift[cluster]
            # The distance to the own centroid: only where the drifted bound does not settle the matter.
            open_rows = np.flatnonzero(~(upper * (1 + SLACK) < certain))
            own = ((x[open_rows] - centroids[cluster[open_rows]]) ** 2).sum(1)
            upper[open_rows] = np.sqrt(own.astype(float))
            ambiguous = open_rows[~(upper[open_rows] * (1 + SLACK) < certain[open_rows])]
            nearest, own, second = _two_nearest(x[ambiguous], centroids)
            cluster[ambiguous], upper[ambiguous], lower[ambiguous] = nearest, np.sqrt(own.astype(float)), second
            scanned = np.zeros(len(batch), bool)
            scanned[ambiguous] = True
            yield _state(batch, cluster, upper, lower, scanned, ((x - centroids[cluster]) ** 2).sum(1))

    return tighten


def _summer(k: int, dimensions: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, radius = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            x, cluster = _matrix(batch["code"], dimensions).astype(np.int64), batch["cluster"].to_numpy()
            order = np.argsort(cluster, kind="stable")
            heads = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if len(heads):
                total[cluster[order[heads]]] += np.add.reduceat(x[order], heads)
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, batch["upper"].to_numpy())
        held = np.flatnonzero(count)
        # One row per component; the count and the radius travel with each.
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(np.repeat(held, dimensions).astype(np.int32)),
                "place": pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(held))),
                "total": pa.array(total[held].ravel()),
                "n": pa.array(np.repeat(count[held], dimensions)),
                "radius": pa.array(np.repeat(radius[held], dimensions)),
            }
        )

    return add


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next centroids and the radius of each cluster's sphere around its present one."""
    k, dimensions = centroids.shape
    parts = state.select("code", "cluster", "upper").mapInArrow(_summer(k, dimensions), "cluster int, place int, total long, n long, radius double")
    # k times `dimensions` rows at most.
    sums = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    new, radii = centroids.copy(), np.zeros(k)
    for r in sums:
        new[r.cluster, r.place] = r.total // r.n
        radii[r.cluster] = r.radius
    return new, radii * (1 + SLACK)


def first_centroids(codes: DataFrame, k: int, dimensions: int, seed: int) -> np.ndarray:
    """The vectors whose `seed:vec_id` has the smallest SHA-256, in that order; null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = codes.orderBy(order.asc_nulls_last(), "code").limit(k).collect()
    return np.array([r.code for r in rows], np.int64).reshape(-1, dimensions)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Cluster, squared distance and inertia of every usable row of `vectors` (vec_id, embedding).

    A component x becomes floor(scale * x). Rows whose embedding is null, has another
    number of components, or holds a null, a value that is no finite number or one beyond
    2**27 / scale (whose distance a long may not hold) are left out. `rounds` times every
    vector goes to its nearest centroid (the smaller number on ties) and every non-empty
    centroid moves to the floor of its vectors' mean; a last assignment follows. With
    fewer than k usable rows each is a centroid. Repeated rows and equal or null ids are
    assigned row by row; a null id becomes a first centroid only if others run out.
    Other columns are left aside; an empty table gives no rows.

    Columns: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and
    scanned: whether the last assignment had to compare the vector with all centroids.
    The sums of inertia are null beyond a long. Only k centroids reach the driver; each
    round writes the vectors' bounds to the shared folder and moves k sums per task.
    """
    embedding = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding")).filter(_usable(F.col("embedding"), scale, dimensions))
    codes = persist_reliably(usable.mapInArrow(_coder(scale, dimensions), "vec_id long, code array<int>"))
    centroids = first_centroids(codes, k, dimensions, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
    state = persist_reliably(codes.mapInArrow(_starter(centroids), _STATE))
    for _ in range(rounds):
        moved, radii = _moved(state, centroids)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float)) * (1 + SLACK)
        loose = loosening(centroids, moved, radii)
        centroids = moved
        state = persist_reliably(state.mapInArrow(_tightener(centroids, drift, loose), _STATE))
    # At most k rows; a sum beyond a long is null.
    sums = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    named = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), long(sums.get(i, 0)), long(sum(sums.values()))) for i, c in enumerate(centroids.tolist())]
    facts = state.sparkSession.createDataFrame(named, "cluster int, centroid_sha256 string, cluster_inertia long, inertia long")
    joined = state.join(F.broadcast(facts), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
