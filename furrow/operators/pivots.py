"""Closest profiles by cosine, with slices of the catalogue skipped by their angle to a pivot.

Angles between vectors obey the triangle inequality. Every catalogue vector belongs to its
nearest pivot, and all vectors of a pivot lie within a range of angles around it, so a
request's own angle to the pivot bounds its cosine with any of them. A request looks at
its nearest pivot's vectors first and then only at pivots that could still hold a closer
one than the k-th so far: nothing is lost.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.recommend import top_k
from furrow.session import persist_reliably

# Task functions travel with the job: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])

PIVOTS = 16
SLICE_VECTORS = 256
# Requests that meet a slice together, and requests whose best a task keeps before it hands them on.
BLOCK_REQUESTS = 256
KEPT_REQUESTS = 1 << 18
# Products of matrices round otherwise than sums in order; cosines this close are worked out in order.
CLOSE = 2e-9
# Bounds are trusted beyond the rounding of arc cosines only.
MARGIN = 1e-6


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def _vectors(frame: DataFrame, vector: str) -> DataFrame:
    """Adds `_v` as doubles and its length `_size`; rows without a direction go."""
    typed = frame.withColumn("_v", F.transform(vector, lambda x: x.cast("double")))
    return typed.withColumn("_size", _norm(F.col("_v"))).filter("_size > 0 and not isnan(_size) and _size < double('infinity')")


def _angles(pivots: list[list[float]]) -> Column:
    """Angles of `_v` to the pivots, which are unit vectors."""
    # One folded constant, whatever the number of components.
    known = F.from_json(F.lit(json.dumps(pivots)), "array<array<double>>")
    dot = lambda p: F.aggregate(F.zip_with(p, F.col("_v"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.transform(known, lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p) / F.col("_size")))))


def _matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors, one matrix per number of components."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(ends[rows] - size)[:, None] + np.arange(size)]


def _summed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of rows added component by component."""
    total = np.zeros(len(left))
    for place in range(left.shape[1]):
        total += left[:, place] * right[:, place]
    return total


def _billionths(values: np.ndarray) -> np.ndarray:
    """Values to nine digits, halves away from zero, as whole numbers."""
    scaled = np.abs(values) * 1e9
    units = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        units[i] = int(abs(Decimal(repr(float(values[i])))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return (np.sign(values) * units).astype(np.int64)


def _closest(key: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows of a block of requests and a slice of profiles: the best k a task saw per request."""

    def found(best: dict, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = [(number, entry) for number, entries in best.items() for entry in entries]
        for at in range(0, len(rows), 10000):
            some = rows[at : at + 10000]
            columns = [pa.array([n for n, _ in some], pa.int64()), pa.array([e[2] for _, e in some], key_type), pa.array([-e[0] / 1e9 for _, e in some], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", key, "similarity"])

    def update(best: dict, numbers: np.ndarray, asked: np.ndarray, keys: list, known: np.ndarray, sizes: np.ndarray) -> None:
        lengths = np.sqrt(_summed(asked, asked))
        near = (asked / lengths[:, None]) @ (known / sizes[:, None]).T
        full = [best[n][-1] if len(best.get(n, ())) == k else None for n in numbers]
        bar = np.array([-np.inf if last is None else -last[0] / 1e9 for last in full])
        fresh = np.flatnonzero(np.isneginf(bar))
        if len(keys) > k and len(fresh):
            bar[fresh] = np.partition(near[fresh], len(keys) - k, axis=1)[:, len(keys) - k]
        i, j = np.nonzero(near >= bar[:, None] - CLOSE)
        if not len(i):
            return
        with np.errstate(all="ignore"):
            cosine = _summed(asked[i], known[j]) / (lengths[i] * sizes[j])
        units = _billionths(np.where(np.isfinite(cosine), cosine, near[i, j]))
        closer: dict[int, list] = {}
        least = np.array([np.iinfo(np.int64).min if last is None else -last[0] for last in full])
        for at in np.flatnonzero(units >= least[i]):
            entry, last = (-int(units[at]), keys[j[at]] is not None, keys[j[at]]), full[i[at]]
            if last is None or entry < last:
                closer.setdefault(i[at], []).append(entry)
        for row, entries in closer.items():
            best[numbers[row]] = sorted([*best.get(numbers[row], ()), *entries])[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        key_type = pa.int64()
        for batch in batches:
            key_type = batch["packed"].type.value_type.field("key").type
            for block, part in zip(batch["asked"], batch["packed"]):
                numbers, vectors = block.values.flatten()
                keys, profiles, sizes = part.values.flatten()
                numbers, keys, sizes = numbers.to_numpy(), keys.to_pylist(), sizes.to_numpy()
                known = {m.shape[1]: (rows, m) for rows, m in _matrices(profiles)}
                for rows, asked in _matrices(vectors):
                    if asked.shape[1] in known:
                        places, matrix = known[asked.shape[1]]
                        update(best, numbers[rows].tolist(), asked, [keys[p] for p in places], matrix, sizes[places])
                if len(best) > KEPT_REQUESTS:
                    yield from found(best, key_type)
                    best = {}
        yield from found(best, key_type)

    return run


def _met(asked: DataFrame, packed: DataFrame, key: str, k: int, salts: int) -> DataFrame:
    """The closest profiles of each request in the slices of its pivot, k at most per task: (_id, key, similarity).

    Requests meet slices in blocks, as products of two matrices. A crowded pivot's slices
    are dealt to `salts` tasks, to which its requests are copied.
    """
    counts = {r["_pivot"]: r["count"] for r in asked.groupBy("_pivot").count().collect()}
    blocks = F.array(*[F.lit(-(-counts.get(p, 0) // BLOCK_REQUESTS)) for p in range(max(counts, default=0) + 1)])
    block = F.pmod(F.xxhash64("_id"), F.get(blocks, F.col("_pivot")))
    grouped = asked.groupBy("_pivot", block.alias("_block")).agg(F.collect_list(F.struct("_id", "_v")).alias("asked"))
    tasks = 4 * asked.sparkSession.sparkContext.defaultParallelism
    copied = grouped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = copied.repartition(tasks, "_pivot", "_salt").join(packed.repartition(tasks, "_pivot", "_salt"), ["_pivot", "_salt"])
    key_type = packed.schema["packed"].dataType.elementType["key"].dataType
    return pairs.select("asked", "packed").mapInArrow(_closest(key, k), f"_id bigint, `{key}` {key_type.simpleString()}, similarity double")


def cosine_top_k_pruned(requests: DataFrame, profiles: DataFrame, vector: str, profile_key: str, k: int, pivots: int = PIVOTS, slice_vectors: int = SLICE_VECTORS) -> DataFrame:
    """The k profiles closest by cosine per request: rank, the profile key, similarity and `compared`.

    Ties go to the smaller key; similarities are compared to nine digits. `profiles` has
    the key and a `centroid`. Requests and profiles whose vector is null, empty, zero or
    not finite match nothing. `compared` counts the profiles whose cosine was worked out
    for the request. Only the pivots and one range of angles each reach the driver;
    slices hold about `slice_vectors` profiles, so a crowded pivot is many rows.
    """
    catalogue = persist_reliably(_vectors(profiles.select(profile_key, "centroid"), "centroid").drop("centroid"))
    first = catalogue.orderBy(F.xxhash64(profile_key), profile_key).limit(pivots).collect()
    known = [[x / r["_size"] for x in r["_v"]] for r in first]
    if not known:
        return requests.filter(F.lit(False)).drop(vector).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), (profile_key, dict(profiles.dtypes)[profile_key]), ("similarity", "double"), ("compared", "bigint"))])
    angles = _angles(known)
    placed = catalogue.withColumn("_angles", angles).withColumn("_angle", F.array_min("_angles"))
    placed = persist_reliably(placed.withColumn("_pivot", (F.array_position("_angles", F.col("_angle")) - 1).cast("int")).drop("_angles"))
    facts = {r["_pivot"]: r for r in placed.groupBy("_pivot").agg(F.count(F.lit(1)).alias("n"), F.min("_angle").alias("low"), F.max("_angle").alias("high")).collect()}
    ranges = [facts.get(p) for p in range(len(known))]
    numbers = lambda values: F.array(*[F.lit(v) for v in values])
    counts = numbers([r.n if r else 0 for r in ranges])
    low, high = numbers([r.low if r else 0.0 for r in ranges]), numbers([r.high if r else 0.0 for r in ranges])
    part = F.pmod(F.xxhash64(profile_key), F.ceil(F.get(counts, F.col("_pivot")) / slice_vectors))
    entry = F.struct(F.col(profile_key).alias("key"), F.col("_v").alias("v"), F.col("_size").alias("size"))
    packed = placed.groupBy("_pivot", part.alias("_part")).agg(F.collect_list(entry).alias("packed"))
    salts = max(1, -(-4 * requests.sparkSession.sparkContext.defaultParallelism // len(known)))
    packed = persist_reliably(packed.select("_pivot", F.pmod("_part", F.lit(salts)).cast("int").alias("_salt"), "packed"))
    asked = _vectors(requests, vector).withColumn("_id", F.monotonically_increasing_id()).withColumn("_angles", angles)
    places = F.sequence(F.lit(0), F.lit(len(known) - 1))
    bound = lambda i: F.greatest(F.lit(0.0), F.get(F.col("_angles"), i) - F.get(high, i), F.get(low, i) - F.get(F.col("_angles"), i))
    # Pivots with k profiles first, as they set the bar at once; then the nearest.
    order = F.transform(F.filter(places, lambda i: F.get(counts, i) > 0), lambda i: F.struct(F.get(counts, i) < k, bound(i).alias("bound"), F.get(F.col("_angles"), i), i.alias("pivot")))
    asked = persist_reliably(asked.withColumn("_bounds", F.array_sort(order)).withColumn("_pivot", F.col("_bounds")[0]["pivot"]).drop("_angles", vector))
    best = persist_reliably(top_k(_met(asked, packed, profile_key, k, salts), ["_id"], k, "similarity", profile_key).drop("rank"))
    bar = best.groupBy("_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("_bar"))
    rest = asked.join(bar, "_id", "left").withColumn("_next", F.explode(F.slice("_bounds", 2, len(known))))
    rest = rest.filter(F.col("_bar").isNull() | (F.cos("_next.bound") + MARGIN >= F.col("_bar"))).withColumn("_pivot", F.col("_next.pivot"))
    rest = persist_reliably(rest.select("_id", "_v", "_pivot"))
    found = top_k(best.unionByName(_met(rest, packed, profile_key, k, salts)), ["_id"], k, "similarity", profile_key)
    size = F.get(counts, F.col("_pivot"))
    compared = asked.select("_id", size.alias("n")).unionAll(rest.select("_id", size.alias("n"))).groupBy("_id").agg(F.sum("n").cast("bigint").alias("compared"))
    kept = [c for c in requests.columns if c != vector]
    joined = asked.select("_id", *kept).join(compared, "_id").join(found, "_id")
    return joined.select(*kept, "rank", profile_key, "similarity", "compared")
