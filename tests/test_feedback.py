import datetime as dt
import random

import pytest

from furrow.operators import feedback
from furrow.sources import logs
from furrow.streaming import feedback as streams
from furrow.streaming import runs

BOUND = "2 HOURS"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    requests = [(i, start + dt.timedelta(minutes=7 * i, microseconds=i), i % 5, i % 3, round(rng.random(), 3)) for i in range(300)]
    reactions = []
    for n in range(500):
        request = 7 if rng.random() < 0.35 else rng.randint(-3, 310)
        moment = start + dt.timedelta(minutes=7 * request + rng.randint(-30, 200), seconds=n)
        reactions.append((n, request, moment, 1, rng.choice([1, -1])))
    return (
        requests,
        reactions,
        spark.createDataFrame(requests, logs.INFERENCE_SCHEMA),
        spark.createDataFrame(reactions, logs.FEEDBACK_SCHEMA),
    )


def expected(requests, reactions):
    out = {}
    for request in requests:
        hits = [
            (moment, n, rating)
            for n, about, moment, _, rating in reactions
            if about == request[0] and request[1] <= moment <= request[1] + dt.timedelta(hours=2)
        ]
        out[request[0]] = (min(hits)[0], int(min(hits)[2] > 0)) if hits else (None, None)
    return out


def shown(samples):
    return {r.request_id: (r.feedback_ts, r.label) for r in samples.collect()}


def test_first_feedback_labels_the_request(data):
    requests, reactions, inference, ratings = data
    samples = feedback.training_samples(inference, ratings, BOUND)
    assert samples.count() == len(requests)
    assert shown(samples) == expected(requests, reactions)


def test_stream_equals_batch(spark, data, tmp_path):
    requests, reactions, inference, ratings = data
    first, second = str(tmp_path / "inference"), str(tmp_path / "feedback")
    half = inference.selectExpr("percentile_approx(unix_micros(ts), 0.5) as h").first().h

    def pairs(read):
        left = streams.unique_events(read(first, logs.INFERENCE_SCHEMA), "request_id", "1 hour")
        right = streams.unique_events(read(second, logs.FEEDBACK_SCHEMA), "feedback_id", "1 hour")
        return streams.labelled_pairs(left, right, BOUND)

    for test in (f"unix_micros(ts) < {half}", f"unix_micros(ts) >= {half}"):
        logs.append_log(inference.union(inference.filter("request_id % 2 = 0")).filter(test), first)
        logs.append_log(ratings.union(ratings.filter("feedback_id % 3 = 0")).filter(test), second)
        size = logs.read_log(spark, first, logs.INFERENCE_SCHEMA).count()
        runs.append_to_parquet(pairs(lambda p, schema: logs.stream_log(spark, p, schema)), str(tmp_path / "pairs"), str(tmp_path / "ck"))
    whole = pairs(lambda p, schema: logs.read_log(spark, p, schema))
    samples = streams.settle(streams.close_bounded(spark.read.parquet(str(tmp_path / "pairs")), whole, ["request_id"]))
    assert logs.read_log(spark, first, logs.INFERENCE_SCHEMA).count() == size
    assert samples.count() == len(requests)
    assert shown(samples) == expected(requests, reactions)


def labels_stream(spark, first, second):
    return streams.first_labels(
        logs.stream_log(spark, first, logs.INFERENCE_SCHEMA).withWatermark("ts", "1 hour"), logs.stream_log(spark, second, logs.FEEDBACK_SCHEMA).withWatermark("ts", "1 hour"), BOUND
    )


def test_chained_stream_labels_each_request_once(spark, data, tmp_path):
    requests, reactions, inference, ratings = data
    first, second, out = str(tmp_path / "inference"), str(tmp_path / "feedback"), str(tmp_path / "samples")
    half = inference.selectExpr("percentile_approx(unix_micros(ts), 0.5) as h").first().h
    for test in (f"unix_micros(ts) < {half}", f"unix_micros(ts) >= {half}"):
        logs.append_log(inference.filter(test), first)
        logs.append_log(ratings.filter(test), second)
        runs.append_to_parquet(labels_stream(spark, first, second), out, str(tmp_path / "ck"))
    emitted = spark.read.parquet(out)
    assert emitted.count() == emitted.select("request_id").distinct().count() > len(requests) / 2
    want = expected(requests, reactions)
    assert shown(emitted).items() <= want.items()
    whole = streams.first_labels(inference, ratings, BOUND)
    assert shown(streams.close_bounded(emitted, whole, ["request_id"])) == want


def test_state_of_a_request_does_not_follow_its_feedback(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    states = {}
    for times in (1, 400):
        first, second = str(tmp_path / f"inference{times}"), str(tmp_path / f"feedback{times}")
        requests = [(i, start + dt.timedelta(minutes=i), 1, 1, 0.5) for i in range(20)]
        reactions = [(i * times + n, i, start + dt.timedelta(minutes=i, seconds=1 + n), 1, 1) for i in range(20) for n in range(times)]
        # A later request and a later reaction: the clock moves on past the first ones, but not past their bound.
        requests.append((99, start + dt.timedelta(minutes=150), 1, 1, 0.5))
        reactions.append((10**6, 99, start + dt.timedelta(minutes=151), 1, 1))
        logs.append_log(spark.createDataFrame(requests, logs.INFERENCE_SCHEMA), first)
        logs.append_log(spark.createDataFrame(reactions, logs.FEEDBACK_SCHEMA), second)
        progress = runs.append_to_parquet(labels_stream(spark, first, second), str(tmp_path / f"out{times}"), str(tmp_path / f"ck{times}"))
        states[times] = sorted(o.numRowsTotal for o in progress[-1].stateOperators)
    assert states[1] == states[400]


def test_two_sinks(spark, data, tmp_path):
    requests, _, inference, _ = data
    source = str(tmp_path / "log")
    logs.append_log(inference, source)
    write = streams.two_sinks(str(tmp_path / "j"), str(tmp_path / "c"))
    runs.for_each_batch(logs.stream_log(spark, source, logs.INFERENCE_SCHEMA), write, str(tmp_path / "ck"))
    write(inference, 0)  # a repeated batch replaces itself
    as_json = logs.read_log(spark, str(tmp_path / "j"), logs.INFERENCE_SCHEMA).drop("batch")
    as_csv = logs.read_csv(spark, str(tmp_path / "c"), logs.INFERENCE_SCHEMA).drop("batch")
    assert sorted(as_json.collect()) == sorted(as_csv.collect()) == sorted(inference.collect())


def test_dedupe_keeps_the_earliest(spark, data):
    _, _, inference, _ = data
    late = inference.selectExpr("request_id", "ts + INTERVAL 1 HOUR as ts", "user_id", "crop_id", "score")
    assert sorted(feedback.dedupe_events(inference.union(late), "request_id").collect()) == sorted(inference.collect())


def test_summary_totals(data):
    _, _, inference, ratings = data
    samples = feedback.training_samples(inference, ratings, BOUND)
    rows = feedback.training_summary(samples, ["crop_id"]).collect()
    total = [r for r in rows if r.level == 3][0]
    assert total.n == 300 and total.n == sum(r.n for r in rows if r.level == 0)
    assert total.n_labelled == samples.filter("label is not null").count()


def test_concentration(spark):
    frame = spark.createDataFrame([("r", 1), ("r", 1), ("r", 1), ("r", 2)], "region string, crop_id int")
    row = feedback.competition_overview(frame).first()
    assert (row.n_picks, row.n_crops, row.lead_crop, row.lead_share, row.concentration) == (4, 2, 1, 0.75, 0.625)
