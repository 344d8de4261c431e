import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from furrow.llm.drift_clusters import cluster, loosening, seen_drift, squared

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance int"


def brute(rows, k, rounds, dimensions):
    kept = [(r[0], [math.floor(Fraction(float(np.float32(x))) * 64) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == dimensions and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        held = assign()
        for i in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, held) if c == i]
            if own:
                centroids[i] = [sum(column) // len(own) for column in zip(*own)]
    held = assign()
    sums = {i: sum(d for d, c in held if c == i) for i in range(len(centroids))}
    return [(v, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (v, _), (d, c) in zip(kept, held)]


def vectors(seed, n, dimensions=64, groups=7, width=0.2):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(groups)]
    return [(i, [m + rng.gauss(0, width) for m in rng.choice(middles)], i % 3, "x", 1) for i in range(n)]


def odd_rows():
    whole = [0.5] * 64
    return [(900, None, 0, None, 0), (901, [], 0, None, 0), (902, whole[:63], 0, "y", 0), (903, whole + [0.5], 0, "y", 0), (904, [None] + whole[1:], 0, "y", 0),
            (905, [float("nan")] + whole[1:], 0, "y", 0), (906, [float("inf")] + whole[1:], 0, "y", 0), (None, whole, 0, "y", 0), (5, whole, None, None, None), (5, whole, None, None, None)]


def got(frame):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    for seed, n in ((1, 300), (2, 60), (3, 9)):
        rows = vectors(seed, n) + odd_rows()
        rows += [(2000 + i, rows[0][1], 0, "c", 0) for i in range(n // 3)]
        frame = cluster(spark.createDataFrame(rows, SCHEMA).repartition(4))
        assert got(frame) == sorted(brute(rows, 16, 3, 64), key=repr)


def test_large_components_and_ties(spark):
    rng = random.Random(4)
    # Whole steps of 1/64 in few dimensions give many ties; large ones leave the range of exact doubles.
    rows = [(i, [rng.randrange(-3, 4) / 64 for _ in range(3)], 0, "x", 0) for i in range(200)]
    assert got(cluster(spark.createDataFrame(rows, SCHEMA), k=8, rounds=4, dimensions=3)) == sorted(brute(rows, 8, 4, 3), key=repr)
    rows = [(i, [float(rng.randrange(-(1 << 20), 1 << 20)) for _ in range(3)], 0, "x", 0) for i in range(60)]
    assert got(cluster(spark.createDataFrame(rows, SCHEMA), k=5, rounds=3, dimensions=3)) == sorted(brute(rows, 5, 3, 3), key=repr)


def test_few_rows_and_empty_tables(spark):
    rows = [(None, [1.0] * 64, 0, "x", 0)]
    assert got(cluster(spark.createDataFrame(rows, SCHEMA))) == [(None, 0, 0, 0, 0, hashlib.sha256(",".join(["64"] * 64).encode()).hexdigest())]
    assert cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cluster(spark.createDataFrame(odd_rows()[:7], SCHEMA)).count() == 0


def test_most_vectors_of_apart_groups_are_not_compared_again(spark):
    rows = vectors(6, 1500, groups=16, width=0.05)
    scanned = [r.scanned for r in cluster(spark.createDataFrame(rows, SCHEMA), rounds=6).collect()]
    assert len(scanned) == 1500 and sum(scanned) < 450


def test_no_place_in_a_sphere_sees_more_drift_and_most_see_less():
    rng = np.random.default_rng(3)
    for dimensions in (2, 3, 20):
        old, new = rng.normal(size=(5, dimensions)), rng.normal(size=(5, dimensions))
        new[4] = old[4]
        centres, radii = 3 * rng.normal(size=(6, dimensions)), rng.uniform(0, 2, 6)
        bound = seen_drift(old, new, centres, radii)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        assert (bound <= drift * (1 + 1e-8)).all() and (bound < 0.9 * drift).any() and (bound[:, 4] == 0).all()
        for i in range(6):
            way = rng.normal(size=(4000, dimensions))
            places = centres[i] + radii[i] * way / np.sqrt((way * way).sum(1))[:, None] * rng.uniform(0.9, 1, 4000)[:, None]
            nearer = np.sqrt(((places[:, None] - old) ** 2).sum(2)) - np.sqrt(((places[:, None] - new) ** 2).sum(2))
            assert (nearer.max(0) <= bound[i] + 1e-9).all()
    loose = loosening(old, new, np.full(5, 0.1))
    assert (loose <= drift.max() + 1e-9).all() and (loose < drift.max()).any()


def test_distances_are_exact_on_both_ways():
    rng = np.random.default_rng(1)
    for reach in (50, 1 << 26):
        x, c = rng.integers(-reach, reach, (30, 8)), rng.integers(-reach, reach, (4, 8))
        want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
        assert squared(x, c).tolist() == want
