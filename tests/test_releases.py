import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from furrow.operators import releases


@pytest.fixture(scope="module")
def runs(spark):
    rng = random.Random(8)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(1500):
        project = 0 if rng.random() < 0.4 else rng.randint(1, 30)
        moment = start + dt.timedelta(hours=rng.randint(0, 24 * 60))
        rows.append((project, i, moment, round(rng.random(), 2), rng.random() < 0.6, rng.randint(1, 99)))
    schema = "project int, run_id int, created_at timestamp, metric double, complete boolean, size_bytes bigint"
    return rows, spark.createDataFrame(rows, schema).repartition(6)


def by_project(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return {p: sorted(g, key=lambda r: (r[2], r[1])) for p, g in groups.items()}


def test_successor_in_a_hot_group(runs):
    rows, frame = runs
    out = releases.with_successor(frame.withColumn("day", F.to_date("created_at")), ["project"], ["created_at", "run_id"], "day")
    got = {r.run_id: r.next.run_id if r.next else None for r in out.collect()}
    want = {}
    for group in by_project(rows).values():
        for row, later in zip(group, [*group[1:], None]):
            want[row[1]] = later[1] if later else None
    assert got == want


def test_lifecycle(runs):
    rows, frame = runs
    got = {r.run_id: r for r in releases.lifecycle(frame, "2020-03-15", keep=2, max_age_days=20).collect()}
    assert len(got) == len(rows)
    for group in by_project(rows).values():
        newest = {r[1] for r in group[-2:]}
        for row in group:
            age = (dt.date(2020, 3, 15) - row[2].date()).days
            assert got[row[1]].age_days == age
            assert got[row[1]].keep == (row[1] in newest or age <= 20)
    report = frame.sparkSession.createDataFrame(list(got.values()))
    assert sum(r.n_runs for r in releases.lifecycle_summary(report).collect()) == len(rows)


def test_active_release(runs):
    rows, frame = runs
    got = {(r.project, r.policy): r.run_id for r in releases.active_release(frame).collect()}
    for project, group in by_project(rows).items():
        assert got[project, "latest"] == group[-1][1]
        done = [r for r in group if r[4]]
        champion = max(done, key=lambda r: (r[3], r[2], r[1]))[1] if done else None
        assert got.get((project, "champion")) == champion


def test_missing_artifacts(spark):
    rows = [("a", "x", True), ("a", "y", False), ("b", "x", True), ("b", "y", True), ("c", "z", True)]
    frame = spark.createDataFrame(rows, "run_id string, artifact_key string, exists boolean")
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "run_id string")
    got = {r.run_id: r.missing for r in releases.missing_artifacts(runs, frame, ["y", "x"]).collect()}
    assert got == {"a": "y", "c": "x,y", "none": "x,y"}
