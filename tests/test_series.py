import math
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.operators import boosting, features, forecast
from furrow.session import persist_reliably


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    return {c: [(t, round(rng.uniform(1, 900), 2)) for t in sorted(rng.sample(range(360, 420), 25))] for c in range(4)}


@pytest.fixture(scope="module")
def series(spark, points):
    rows = [(c, t, Decimal(str(v))) for c, ps in points.items() for t, v in ps]
    return spark.createDataFrame(rows, "crop_id int, t int, value decimal(18,2)")


def test_half_up_price(spark):
    rows = [(Decimal("0.25"), Decimal(2)), (Decimal("1.00"), Decimal(3)), (Decimal("2.00"), Decimal(3)), (Decimal("68423.45"), Decimal(8))]
    frame = spark.createDataFrame(rows, "a decimal(18,2), u decimal(18,2)")
    got = [str(r[0]) for r in frame.select(exact.half_up_price(F.col("a"), F.col("u"))).collect()]
    assert got == ["0.13", "0.33", "0.67", "8552.93"]


def test_lags_and_rolling(points, series):
    out = features.lag_features(series, ["crop_id"], "value", lags=(1, 3), windows=(3, 12)).collect()
    for row in out:
        values = [v for t, v in points[row.crop_id] if t < row.t]
        assert row.lag_1 == (Decimal(str(values[-1])) if values else None)
        for k in (3, 12):
            last = values[-k:]
            if last:
                assert row[f"mean_{k}"] == pytest.approx(np.mean(last))
            else:
                assert row[f"mean_{k}"] is None
            if len(last) > 1:
                assert row[f"std_{k}"] == pytest.approx(np.std(last, ddof=1), rel=1e-9)
            else:
                assert row[f"std_{k}"] is None


def test_trend_matches_polyfit(points, series):
    for row in forecast.forecast_trend(forecast.fit_trend(series, ["crop_id"]), ["crop_id"], 2).collect():
        t, v = zip(*points[row.crop_id])
        slope, intercept = np.polyfit(t, v, 1)
        assert row.forecast == pytest.approx(intercept + slope * row.t, rel=1e-6)


def test_backtest_sees_only_the_past(points, series):
    rows = forecast.backtest(series, ["crop_id"], horizon=3, min_history=3).collect()
    want = 0
    for crop, ps in points.items():
        for t, _ in ps:
            want += 3 * sum(1 for h in range(3) if sum(1 for s, _ in ps if s < t - h) >= 3)
    assert len(rows) == want
    for row in rows:
        past = [(t, v) for t, v in points[row.crop_id] if t < row.cutoff]
        assert row.cutoff <= row.t < row.cutoff + 3
        if row.member == "last":
            assert row.forecast == past[-1][1]
        elif row.member == "mean":
            assert row.forecast == pytest.approx(np.mean([v for _, v in past]))
        else:
            slope, intercept = np.polyfit(*zip(*past), 1)
            assert row.forecast == pytest.approx(intercept + slope * row.t, rel=1e-4, abs=1e-3)


def test_report_and_blend(series):
    wide = forecast.backtest_wide(series, ["crop_id"])
    long = forecast.to_long(wide).toPandas()
    error = long.forecast - long.actual
    report = {r.member: r for r in forecast.evaluate(forecast.to_long(wide), ["member"]).collect()}
    assert report["ALL"].n == len(long)
    assert report["ALL"].mae == pytest.approx(error.abs().mean(), abs=1e-6)
    assert report["ALL"].rmse == pytest.approx(math.sqrt((error**2).mean()), rel=1e-4)
    spread = ((long.actual - long.actual.mean()) ** 2).sum()
    assert report["ALL"].r2 == pytest.approx(1 - (error**2).sum() / spread, rel=1e-4)
    weights = forecast.blend_weights(wide, ["crop_id"])
    for row in weights.collect():
        assert row.w_trend + row.w_last + row.w_mean == pytest.approx(1)
    for row in forecast.blend(wide, weights, ["crop_id"]).collect():
        members = [row.trend, row["last"], row["mean"]]
        assert min(members) - 1e-6 <= row.blended <= max(members) + 1e-6


def test_unmapped_and_conform(spark):
    source = spark.createDataFrame([(" RICE ",), ("rice",), ("Oat",)], "source_name string")
    mapping = spark.createDataFrame([("Rice", 7), ("rice ", 9)], "source_name string, crop_id int")
    assert sorted(r.crop_id or 0 for r in features.conform(source, mapping).collect()) == [0, 7, 7]
    assert [(r.name_key, r.n_rows) for r in features.unmapped(source, mapping).collect()] == [("oat", 1)]


def test_boosting_learns_the_last_value(spark):
    rows = [(float(i % 40), float((i % 40) * 2)) for i in range(400)]
    frame = spark.createDataFrame(rows, "lag double, price double")
    model = forecast.train_global(frame, ["lag"], "price", maxIter=8, maxDepth=4)
    worst = model.transform(frame).select(F.max(F.abs(F.col("forecast") - F.col("price")))).first()[0]
    assert worst < 15


def test_boosting_over_blocks_grows_the_same_trees(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1), rng.choice([0.0, 0.0, 1.0, 2.5]), float(rng.randrange(60)), 1.0) for _ in range(11_000)]
    rows = [(*r, 3 * r[0] + r[1] * r[2] + rng.gauss(0, 0.3)) for r in rows] + [(None, 1.0, 2.0, 1.0, 3.0), (1.0, 1.0, 2.0, 1.0, None)]
    frame = persist_reliably(spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(5))
    spark_model = forecast.train_global(frame, ["a", "b", "c", "d"], "y", maxIter=4, maxDepth=4)
    monkeypatch.setattr(forecast, "IN_MEMORY_ROWS", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 3_000)
    fits = []
    monkeypatch.setattr(Pipeline, "fit", lambda *_: fits.append(1))
    model = forecast.train_global(frame, ["a", "b", "c", "d"], "y", maxIter=4, maxDepth=4)
    assert not fits and model.stages[1].treeWeights == [1.0, 0.1, 0.1, 0.1]
    shape = lambda m: [re.sub(r"uid=\S+", "", re.sub(r"(\d\.\d{4})\d*", r"\1", t.toDebugString)) for t in m.stages[1].trees]
    assert shape(model) == shape(spark_model)
    both = zip(*([r.forecast for r in m.transform(frame.filter("a is not null")).collect()] for m in (model, spark_model)))
    assert all(x == pytest.approx(y, rel=1e-9) for x, y in both)


def test_thresholds_count_missing_rows_as_zeros():
    values = np.array([0.0, 0.0, 1.0, 2.0, 2.0, 5.0])
    assert boosting.thresholds_of(values, 6, 31).tolist() == [0.5, 1.5, 3.5]
    assert boosting.thresholds_of(values[2:], 6, 31).tolist() == [0.5, 1.5, 3.5]
    assert boosting.thresholds_of(np.ones(4), 4, 31).tolist() == []
    assert boosting.thresholds_of(np.arange(1.0, 101.0), 100, 3).tolist() == [25.5, 50.5, 75.5]


def ridge_by_numpy(rows, penalty):
    x, y = np.array([r[1:-1] for r in rows], float), np.array([r[-1] for r in rows], float)
    middle = x.mean(0)
    gram = (x - middle).T @ (x - middle) + penalty * np.eye(x.shape[1])
    slopes = np.linalg.solve(gram, (x - middle).T @ (y - y.mean()))
    return y.mean() - middle @ slopes, slopes


def test_ridge_equals_the_normal_equations(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        a, b = round(rng.gauss(100, 30), 3), round(rng.gauss(0, 2), 3)
        rows.append((("p", "q", None)[i % 3], a, b, round(a * 0.5 + rng.gauss(0, 1), 3), round(3 * a - 7 * b + rng.gauss(0, 5) + 40, 3)))
    rows += [("p", None, 1.0, 1.0, 1.0), ("p", 1.0, 1.0, 1.0, None), ("r", 1.0, 2.0, 3.0, 4.0), ("empty", None, None, None, None)]
    frame = spark.createDataFrame(rows, "k string, a double, b double, c double, y double")
    whole = [r for r in rows if None not in r[1:]]
    model = forecast.fit_ridge(frame.repartition(5), ["a", "b", "c"], "y", penalty=2.5)
    got, (intercept, slopes) = model.first(), ridge_by_numpy(whole, 2.5)
    assert (got.n, got.intercept) == (len(whole), pytest.approx(intercept, rel=1e-9)) and [got.a, got.b, got.c] == pytest.approx(slopes.tolist(), rel=1e-7)
    scored = forecast.forecast_ridge(frame, model, ["a", "b", "c"]).collect()
    for r in scored:
        want = None if None in (r.a, r.b, r.c) else pytest.approx(intercept + np.dot(slopes, [r.a, r.b, r.c]), rel=1e-9)
        assert r.forecast == want
    groups = forecast.fit_ridge(frame, ["a", "b", "c"], "y", ["k"], penalty=0.5)
    found = {r.k: r for r in groups.collect()}
    assert set(found) == {"p", "q", None, "r"} and (found["r"].n, found["r"].intercept, found["r"].a) == (1, 4.0, 0.0)
    for k in ("p", None):
        intercept, slopes = ridge_by_numpy([r for r in whole if r[0] == k], 0.5)
        assert [found[k].a, found[k].b, found[k].c] == pytest.approx(slopes.tolist(), rel=1e-7)
    by_group = {(r.k, r.a): r.forecast for r in forecast.forecast_ridge(frame, groups, ["a", "b", "c"], ["k"]).collect()}
    first = next(r for r in whole if r[0] is None)
    assert by_group[None, first[1]] == pytest.approx(intercept + np.dot(slopes, first[1:4]), rel=1e-9) and by_group["empty", None] is None


def test_ridge_without_rows_and_without_penalty(spark):
    none = spark.createDataFrame([], "a double, y double")
    model = forecast.fit_ridge(none, ["a"], "y")
    assert model.count() == 0
    assert forecast.forecast_ridge(spark.createDataFrame([(1.0, 2.0)], "a double, y double"), model, ["a"]).first().forecast is None
    with pytest.raises(ValueError):
        forecast.fit_ridge(none, ["a"], "y", penalty=0)


def test_backtest_adds_its_sums_once_for_all_steps(spark):
    series = spark.createDataFrame([("a", t, float(t * t)) for t in (1, 2, 4, 5, 9)], "k string, t int, v double").selectExpr("k", "t", "cast(v as decimal(18,2)) value")
    wide = forecast.backtest_wide(series, ["k"], horizon=4, min_history=1)
    sums = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(" windowspecdefinition(")
    # Six running values, and one look-up a step.
    assert sums(wide) <= 6 + 4
    past = {(t, s): [m for m in (1, 2, 4, 5, 9) if m < t - s] for t in (1, 2, 4, 5, 9) for s in range(4)}
    want = {(t, t - s): (p[-1] ** 2, sum(m * m for m in p) / len(p)) for (t, s), p in past.items() if p}
    assert {(r.t, r.cutoff): (r["last"], r["mean"]) for r in wide.collect()} == want
