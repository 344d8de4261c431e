import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import pivots
from furrow.operators.pivots import cosine_top_k_pruned


def frames(spark, vectors, centers):
    requests = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in enumerate(vectors)], "id int, v array<double>, similarity_note string")
    return requests, spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(centers)], "crop int, centroid array<double>")


def brute(vectors, centers, k):
    good = lambda v: v is not None and len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0
    out = {}
    for i, v in enumerate(vectors):
        if good(v):
            near = [(-round(float(np.dot(v, c) / np.linalg.norm(v) / np.linalg.norm(c)), 9) + 0.0, j) for j, c in enumerate(centers) if good(c)]
            out[i] = [j for _, j in sorted(near)[:k]]
    return out


def closest(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.id, r["rank"])):
        out.setdefault(r.id, []).append(r.crop)
    return out


@pytest.mark.parametrize("pivots,k", [(1, 3), (5, 1), (8, 4), (40, 30)])
def test_same_rows_as_brute_force(spark, pivots, k):
    rng = np.random.default_rng(pivots)
    groups = rng.normal(size=(6, 7)) * 3
    centers = [*(groups[rng.integers(6, size=120)] + rng.normal(size=(120, 7)) * 0.3), np.zeros(7), None, np.full(7, np.nan), *[groups[0]] * 20]
    vectors = [*(groups[rng.integers(6, size=30)] + rng.normal(size=(30, 7)) * 0.5), np.zeros(7), None, groups[0], groups[0]]
    requests, profiles = frames(spark, vectors, centers)
    got = cosine_top_k_pruned(requests.repartition(3), profiles, "v", "crop", k, pivots, slice_vectors=10)
    assert closest(got) == brute(vectors, centers, k)
    assert got.columns == ["id", "similarity_note", "rank", "crop", "similarity", "compared"]


def test_most_of_a_grouped_catalogue_is_not_compared(spark):
    rng = np.random.default_rng(1)
    groups = rng.normal(size=(12, 24))
    centers = list(groups[np.arange(600) % 12] + rng.normal(size=(600, 24)) * 0.05)
    vectors = list(groups[np.arange(40) % 12] + rng.normal(size=(40, 24)) * 0.05)
    requests, profiles = frames(spark, vectors, centers)
    rows = cosine_top_k_pruned(requests, profiles, "v", "crop", 3, pivots=32).collect()
    compared = {r.id: r.compared for r in rows}
    assert sum(compared.values()) < 0.35 * 40 * 600
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.id, []).append(r.crop)
    assert found == brute(vectors, centers, 3)


def test_empty_sides(spark):
    requests, profiles = frames(spark, [[1.0, 2.0]], [[1.0, 0.0], [0.0, 2.0]])
    assert cosine_top_k_pruned(requests.limit(0), profiles, "v", "crop", 2).count() == 0
    assert cosine_top_k_pruned(requests, profiles.limit(0), "v", "crop", 2).count() == 0
    row = cosine_top_k_pruned(requests, profiles, "v", "crop", 5).orderBy("rank").collect()
    assert [r.crop for r in row] == [1, 0] and {r.compared for r in row} == {2}


def test_ties_null_keys_text_keys_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK_REQUESTS", 4)
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(5, 6))
    # Copies tie exactly; a vector of other length is compared with its like only.
    centers = [(f"k{i:03d}" if i else None, (spots[i % 5] * (1 + i % 3)).tolist()) for i in range(60)] + [("short", [1.0, 2.0])]
    asked = [(i, v.tolist()) for i, v in enumerate([*spots, *rng.normal(size=(20, 6))])] + [(90, [2.0, 4.0])]
    requests = spark.createDataFrame(asked, "id int, v array<double>")
    profiles = spark.createDataFrame(centers, "crop string, centroid array<double>")
    rows = cosine_top_k_pruned(requests.repartition(3), profiles, "v", "crop", 4, pivots=3, slice_vectors=7).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append(r.crop)
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {i: [c for _, _, c in sorted((-round(cosine(v, w), 9), c or "", c) for c, w in centers if len(w) == len(v))[:4]] for i, v in asked}
    assert got == want and got[90] == ["short"] and got[0][0] is None


def test_nine_digits_are_rounded_as_spark_does(spark):
    values = np.array([0.1234567895, -0.1234567895, 0.1234567894999, 0.0000000005, -4e-10, 1.0, -0.9999999995, 0.3, 0.7071067811865476])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(F.round("x", 9)).collect()]
    assert (pivots._billionths(values) / 1e9).tolist() == [w + 0.0 for w in want]


def test_a_request_costs_no_row_per_slice(spark):
    """Slices of one vector each: what leaves the comparison is k rows per request and task, not one per slice."""
    rng = np.random.default_rng(4)
    packed = spark.createDataFrame([(0, 0, [(i, [float(x) for x in rng.normal(size=4)], 1.0)]) for i in range(300)], "_pivot int, _salt int, packed array<struct<key:int,v:array<double>,size:double>>")
    asked = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(10)], "_id bigint, _v array<double>, _pivot int")
    assert pivots._met(asked, packed, "crop", 2, 1).groupBy("_id").count().agg(F.max("count")).first()[0] == 2
