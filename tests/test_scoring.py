import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import calibrate, hulls, recommend


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(800):
        score = 0.5 if rng.random() < 0.33 else round(rng.random(), 3)
        rows.append((score, int(rng.random() < score)))
    return rows, spark.createDataFrame(rows, "score double, label int")


def test_auc_counts_ties_half(scored):
    rows, frame = scored
    pos = np.array([s for s, y in rows if y])
    neg = np.array([s for s, y in rows if not y])
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert calibrate.auc(frame).first().auc == pytest.approx(want, abs=1e-12)


def test_brier_and_bins(scored):
    rows, frame = scored
    assert calibrate.brier_score(frame).first().brier == pytest.approx(np.mean([(s - y) ** 2 for s, y in rows]), abs=1e-7)
    bins = calibrate.reliability_bins(frame, 5)
    assert sum(r.n for r in bins.collect()) == len(rows)
    edge = frame.sparkSession.createDataFrame([(1.0, 1), (0.0, 0)], "score double, label int")
    assert {r.bin for r in calibrate.reliability_bins(edge, 5).collect()} == {0, 4}
    assert 0 <= calibrate.calibration_error(bins).first().ece <= 1


def test_isotonic_is_monotone(scored):
    _, frame = scored
    model = calibrate.fit_isotonic(frame, digits=2)
    points = frame.select(F.round("score", 2).alias("score")).distinct()
    values = [r.probability for r in model.transform(points).orderBy("score").collect()]
    assert values == sorted(values)
    assert calibrate.fit_logistic(frame).coefficients[0] > 0


def pooled(counts):
    """Isotonic values by the max-min formula."""
    out = []
    for k in range(len(counts)):
        ends = [min(sum(c[2] for c in counts[a : z + 1]) / sum(c[1] for c in counts[a : z + 1]) for z in range(k, len(counts))) for a in range(k + 1)]
        out.append(max(ends))
    return out


@pytest.mark.parametrize("slices", [1, 2, 5, 8])
@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties"])
def test_hulls_give_the_isotonic_fit_whatever_the_slices(spark, slices, kind):
    rng = random.Random(f"{kind}{slices}")
    counts = []
    for i in range(60):
        n = rng.randint(1, 9) if kind != "ties" else 2
        share = {"noise": rng.random(), "rising": i / 60, "falling": 1 - i / 60, "ties": (i // 10) / 6}[kind]
        counts.append((i / 7, n, round(n * share)))
    frame = spark.createDataFrame(counts, "score double, n bigint, n_pos bigint")
    blocks = hulls.isotonic_blocks(frame.repartition(3), slices)
    found = sorted(blocks.collect())
    assert [r.probability for r in found] == sorted({r.probability for r in found})
    assert sum(r.n for r in found) == sum(c[1] for c in counts)
    fitted = {r.score: r.probability for r in hulls.apply_blocks(frame, blocks).collect()}
    assert [fitted[c[0]] for c in counts] == pytest.approx(pooled(counts), abs=1e-12)


def test_hulls_between_and_beyond_the_scores(spark):
    blocks = hulls.isotonic_blocks(spark.createDataFrame([(0.2, 10, 1), (0.4, 10, 5), (None, 3, 3), (float("nan"), 3, 3)], "score double, n bigint, n_pos bigint"))
    points = spark.createDataFrame([(-1.0,), (0.2,), (0.3,), (0.4,), (9.0,)], "score double")
    assert [r.probability for r in hulls.apply_blocks(points, blocks).orderBy("score").collect()] == pytest.approx([0.1, 0.1, 0.3, 0.5, 0.5])
    none = hulls.isotonic_blocks(spark.createDataFrame([], "score double, n bigint, n_pos bigint"))
    assert none.count() == 0 and {r.probability for r in hulls.apply_blocks(points, none).collect()} == {None}


def test_newton_finds_the_line_of_largest_likelihood(spark, scored):
    rows, frame = scored
    line = calibrate.fit_logistic(frame)
    s, y = np.array(rows).T
    p = 1 / (1 + np.exp(-(line.intercept + line.slope * s)))
    # At the maximum both gradients vanish.
    assert line.settled and line.steps < 10 and abs((y - p).sum()) < 1e-6 and abs(((y - p) * s).sum()) < 1e-6
    schema = "score double, label int"
    far = calibrate.fit_logistic(spark.createDataFrame([(float(i), int(i > 50)) for i in range(100)], schema))
    assert not far.settled and far.slope > 1
    same = calibrate.fit_logistic(spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (None, 1), (0.1, None)], schema))
    assert same.slope == 0 and same.intercept == pytest.approx(np.log(2))
    for rows, share in (([], 0.5), ([(0.1, 1), (0.2, 1)], 2.5 / 3)):
        assert calibrate.fit_logistic(spark.createDataFrame(rows, schema)).intercept == pytest.approx(np.log(share / (1 - share)))


def test_weighted_score_and_top_k(spark):
    rows = [("a" if i % 3 else "b", i, float(i % 50), float(i % 7)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "region string, crop_id int, gain double, cost double")
    out = recommend.weighted_score(frame, {"gain": 0.7, "cost": -0.3}, ["region"])
    for row in out.collect():
        assert row.score == pytest.approx(0.7 * row.gain / 49 + 0.3 * (1 - row.cost / 6))
    best = recommend.top_k(out, ["region"], 4).collect()
    for region in ("a", "b"):
        want = sorted((-(0.7 * g / 49 + 0.3 * (1 - c / 6)), i) for r, i, g, c in rows if r == region)[:4]
        assert [b.crop_id for b in sorted((b for b in best if b.region == region), key=lambda b: b["rank"])] == [i for _, i in want]


def test_constant_criterion_counts_zero(spark):
    frame = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0)], "region string, crop_id int, gain double")
    weights = recommend.weights_of(spark.createDataFrame([("gain", 1.0)], "criterion string, weight double"))
    assert {r.score for r in recommend.weighted_score(frame, weights, ["region"]).collect()} == {0.0}


def test_lookup_falls_back(spark):
    table = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9), (2, 10, 0.1)], "region int, crop int, score double")
    requests = spark.createDataFrame([(0, 1, 10), (1, 1, 99), (2, 3, 10)], "id int, region int, crop int")
    got = {r.id: (r.score, r.origin) for r in recommend.lookup_with_default(requests, table, ["region", "crop"], ["region"], "score").collect()}
    assert got == {0: (0.5, "exact"), 1: (0.9, "default"), 2: (None, "none")}


def test_suitable_matches_brute_force(spark):
    rng = random.Random(4)
    crops = [(c, *sorted((rng.uniform(-20, 40), rng.uniform(-20, 40))), *sorted((rng.uniform(0, 9), rng.uniform(0, 9)))) for c in range(40)]
    places = [(i, 5.0 if i % 3 == 0 else rng.uniform(-25, 45), rng.uniform(0, 9)) for i in range(600)]
    profiles = spark.createDataFrame(crops, "crop int, heat_lo double, heat_hi double, rain_lo double, rain_hi double")
    requests = spark.createDataFrame(places, "id int, heat double, rain double")
    got = sorted((r.id, r.crop) for r in recommend.suitable(requests, profiles, ["heat", "rain"], 3.0).collect())
    want = sorted((i, c) for i, h, w in places for c, a, b, d, e in crops if a <= h <= b and d <= w <= e)
    assert got == want


@pytest.mark.parametrize("small", [True, False], ids=["broadcast", "shuffled"])
def test_profile_matches_go_through_distinct_values_and_many_small_tasks(spark, monkeypatch, small):
    monkeypatch.setattr(recommend, "PAIRS_PER_TASK", 500)
    if not small:
        monkeypatch.setattr(recommend, "BROADCAST_BYTES", 0)
    rng = random.Random(6)
    crops = [(f"c{c}", *sorted((rng.uniform(0, 9), rng.uniform(0, 9)))) for c in range(12)]
    places = [(rng.choice([None, *range(60)]), rng.choice([None, *range(10)])) for _ in range(900)]
    profiles = spark.createDataFrame(crops, "crop string, heat_lo double, heat_hi double")
    requests = spark.createDataFrame(places, "place int, heat int").select("place", F.col("heat").cast("double").alias("heat"))
    seen = []

    def match(points):
        seen.append(points.count())
        return recommend.suitable(points, profiles, ["heat"], 2.0)

    out = recommend.profile_matches(requests, ["heat"], "place", "crop", match, F.max("heat").alias("most"))
    got = {r.crop: (r.n_requests, r.n_places, r.most) for r in out.collect()}
    hits = {c: [(p, h) for p, h in places if h is not None and a <= h <= b] for c, a, b in crops}
    assert got == {c: (len(v), len({p for p, _ in v if p is not None}), max(h for _, h in v)) for c, v in hits.items() if v}
    assert seen == [10] and sum(map(len, hits.values())) > 2000


@pytest.mark.parametrize("slice_bytes", [1 << 24, 400], ids=["one slice", "many slices"])
def test_cosine_top_k(spark, slice_bytes):
    rng = np.random.default_rng(2)
    vectors, centers = rng.normal(size=(30, 5)), rng.normal(size=(17, 5))
    requests = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, v array<double>")
    profiles = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centers)], "crop int, centroid array<double>")
    rows = recommend.cosine_top_k(requests, profiles, "v", "crop", 3, slice_bytes, slices_per_stage=2).collect()
    near = vectors @ centers.T / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(centers, axis=1)[None, :]
    for i in range(30):
        assert [r.crop for r in sorted((r for r in rows if r.id == i), key=lambda r: r["rank"])] == np.argsort(-near[i])[:3].tolist()


def test_centroids(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [0.0, 1.0])], "crop int, v array<float>")
    assert {r.crop: r.centroid for r in recommend.centroids(frame, "crop", "v").collect()} == {1: [2.0, 3.0], 2: [0.0, 1.0]}
