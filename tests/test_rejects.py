import pytest
from pyspark.sql import functions as F

from furrow.sources import logs, rejects
from furrow.streaming import runs

SCHEMA = "request_id bigint, ts timestamp, user_id bigint, note string, tags array<string>"
GOOD = [
    '{"request_id": 1, "ts": "2024-01-01T00:00:00.000000Z", "user_id": 2, "note": "a", "tags": ["x"]}',
    '{"request_id": 2, "ts": "2024-01-01T00:00:00.000001+02:00", "more": [1, {"a": 2}]}',
    '  {"request_id": 3, "ts": "2024-01-01T00:00:00.5Z", "user_id": null, "note": "", "tags": []}',
]
BAD = {
    "": "blank",
    " \t": "blank",
    "{broken": "broken",
    '{"request_id": 1, "request_id": 2}': "broken",
    '{"request_id": 1} {"request_id": 2}': "broken",
    '{"request_id": 1},{"request_id": 2}': "broken",
    "[1]": "not an object",
    "7": "not an object",
    "null": "not an object",
    '{"ts": "2024-01-01T00:00:00.000000Z"}': "missing request_id",
    '{"request_id": null, "ts": "2024-01-01T00:00:00.000000Z"}': "missing request_id",
    '{"request_id": 5}': "missing ts",
    '{"request_id": "x5", "ts": "2024-01-01T00:00:00.000000Z"}': "mistyped request_id",
    '{"request_id": 5, "ts": "yesterday"}': "mistyped ts",
    '{"request_id": 5, "ts": "2024-01-01T00:00:00.000000Z", "user_id": 1.5}': "mistyped user_id",
    '{"request_id": 5, "ts": "2024-01-01T00:00:00.000000Z", "tags": {"a": 1}}': "mistyped tags",
    '{"request_id": 99999999999999999999, "ts": "2024-01-01T00:00:00.000000Z"}': "mistyped request_id",
}


def write_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("append").text(path)


def test_every_line_is_a_record_or_a_reject_with_its_reason(spark, tmp_path):
    path = str(tmp_path / "log")
    write_lines(spark, path, GOOD + list(BAD))
    good, rejected = rejects.split_log(rejects.read_lines(spark, path), SCHEMA, ["request_id", "ts"])
    assert {r.request_id for r in good.collect()} == {1, 2, 3}
    assert good.filter("request_id = 1").first().tags == ["x"]
    assert {r.line: r.reason for r in rejected.collect()} == BAD
    assert all("/log/part-" in r.file for r in rejected.union(rejected).collect())
    empty = rejects.split_log(rejects.read_lines(spark, path).limit(0), SCHEMA)
    assert empty[0].isEmpty() and empty[1].isEmpty()
    assert rejects.split_log(rejects.read_lines(spark, path), SCHEMA)[1].filter("reason like 'missing%'").isEmpty()


def test_a_stream_routes_each_line_once_and_keeps_a_ledger(spark, tmp_path):
    path, root = str(tmp_path / "log"), str(tmp_path / "routed")
    sink = rejects.routed_sink(root, SCHEMA, ["request_id", "ts"])
    for turn in range(2):
        write_lines(spark, path, GOOD + list(BAD))
        runs.for_each_batch(rejects.stream_lines(spark, path, 1), sink, str(tmp_path / "ck"))
    good, rejected = rejects.read_routed(spark, root, SCHEMA)
    assert sorted(r.request_id for r in good.collect()) == [1, 1, 2, 2, 3, 3]
    assert {(r.line, r.reason): r["count"] for r in rejected.groupBy("line", "reason").count().collect()} == {(line, reason): 2 for line, reason in BAD.items()}
    entries = rejects.ledger(spark, root).collect()
    assert sum(r.lines for r in entries) == 2 * (len(GOOD) + len(BAD)) and all(r.lines == r.good + r.rejected for r in entries)
    assert len({r.file for r in entries}) == 2 == len({r.batch for r in entries})


def test_unfinished_batches_are_not_seen_and_foreign_ones_not_replaced(spark, tmp_path):
    path, root = str(tmp_path / "log"), str(tmp_path / "routed")
    write_lines(spark, path, GOOD)
    sink = rejects.routed_sink(root, SCHEMA)
    runs.for_each_batch(rejects.stream_lines(spark, path), sink, str(tmp_path / "ck"))
    # A job that stopped after its records and before its ledger entry.
    logs.write_json(spark.createDataFrame([("f", 77)], "file string, request_id bigint"), f"{root}/good/batch=9")
    logs.write_json(spark.createDataFrame([("f", "broken", "{")], rejects.REJECTED), f"{root}/rejected/batch=9")
    good, rejected = rejects.read_routed(spark, root, SCHEMA)
    assert {r.request_id for r in good.collect()} == {1, 2, 3} and rejected.isEmpty()
    # Another checkpoint counts batches from zero again.
    with pytest.raises(Exception, match="was written by query"):
        runs.for_each_batch(rejects.stream_lines(spark, path), sink, str(tmp_path / "other"))
    assert good.agg(F.count(F.lit(1)).alias("n")).first().n == 3
