import random

import pytest
from pyspark.sql import functions as F

from furrow.operators import boxes

INF = float("inf")
PROFILES = "crop int, heat_lo double, heat_hi double, rain_lo double, rain_hi double, soil_lo double, soil_hi double"
REQUESTS = "id int, heat double, rain double, soil double"
FACTORS = ["heat", "rain", "soil"]


def matched(spark, requests, profiles):
    found = boxes.inside_boxes(spark.createDataFrame(requests, REQUESTS).repartition(3), spark.createDataFrame(profiles, PROFILES), FACTORS)
    return sorted((r.id, r.crop) for r in found.collect())


def brute(requests, profiles):
    good = lambda x: x is not None and x == x
    fits = lambda x, lo, hi: good(x) and good(lo) and good(hi) and lo <= x <= hi
    return sorted((i, c) for i, h, r, s in requests for c, a, b, d, e, f, g in profiles if fits(h, a, b) and fits(r, d, e) and fits(s, f, g))


def random_rows(seed, n, m):
    rng = random.Random(seed)
    span = lambda: sorted(rng.choice([rng.uniform(-50, 50), float(rng.randint(-8, 8)), 0.0]) for _ in range(2))
    wide = lambda: rng.choice([[-INF, INF], [-1e300, 1e300], [-INF, 3.0], [1e18, 2e18], [-5.0, 1e7], [2.0, 2.0]])
    profiles = [(c, *(span() if rng.random() < 0.7 else wide()), *span(), *(span() if rng.random() < 0.5 else wide())) for c in range(m)]
    profiles += [(900, 3.0, 1.0, 0.0, 1.0, 0.0, 1.0), (901, None, 1.0, 0.0, 1.0, 0.0, 1.0), (902, float("nan"), 1.0, 0.0, 1.0, 0.0, 1.0)]
    value = lambda: rng.choice([rng.uniform(-60, 60), float(rng.randint(-8, 8)), 2.0, -0.0, 1.5e18, INF, -INF, None, float("nan")])
    return [(i, value(), rng.uniform(-60, 60), value()) for i in range(n)], profiles


@pytest.mark.parametrize("most", [64, 1])
def test_matches_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(boxes, "MOST_SHAPES", most)
    requests, profiles = random_rows(most, 300, 60)
    requests.append(requests[0])
    assert matched(spark, requests, profiles) == brute(requests, profiles)


def test_wide_ranges_do_not_multiply_rows(spark):
    profiles = [(c, -(10.0**c), 10.0**c, 0.0, 1e-9 * c, 0.0, INF) for c in range(16)]
    frame = spark.createDataFrame(profiles, PROFILES)
    shaped, shapes = boxes._shapes(frame, FACTORS)
    cells = shaped
    for f in FACTORS:
        ends = [boxes._cell(F.col(f"{f}_{e}"), F.col(f"_e_{f}")) for e in ("lo", "hi")]
        cells = cells.withColumn(f"_c_{f}", F.explode(F.sequence(*ends)))
    assert cells.groupBy("crop").count().agg(F.max("count")).first()[0] <= 8 and len(shapes) <= boxes.MOST_SHAPES
    requests, _ = random_rows(5, 100, 1)
    assert matched(spark, requests, profiles) == brute(requests, profiles)


def test_empty_tables(spark):
    requests, profiles = random_rows(1, 5, 5)
    assert matched(spark, [], profiles) == [] and matched(spark, requests, []) == [] and matched(spark, requests, profiles[-3:]) == []
