"""Inference logs with lines that do not fit, in batch and as a growing stream.

Views stand for inference; the last digit of a request decides how its line is spoilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.plans.feedback import HALF_WAY, inference_log
from furrow.plans.registry import query
from furrow.session import work_path
from furrow.sources import logs, rejects
from furrow.streaming import runs

REQUIRED = ["request_id", "ts"]

# Rejected lines show their reason and, where the line can still be read, the user.
_SQL = """
WITH v AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, value, event_id % 10 AS d FROM events WHERE event_type = 'view')
SELECT 'good' AS kind, event_id AS request_id, ts_us, user_id, value AS score, '' AS reason FROM v WHERE d > 5
UNION ALL
SELECT 'rejected', -1, -1, CASE WHEN d IN (1, 3, 5) THEN user_id ELSE -1 END, -1,
       CASE d WHEN 0 THEN 'broken' WHEN 1 THEN 'mistyped score' WHEN 2 THEN 'not an object' WHEN 3 THEN 'missing request_id' WHEN 4 THEN 'blank' ELSE 'mistyped request_id' END
FROM v WHERE d <= 5
"""


def _spoilt(spark: SparkSession, base: str) -> DataFrame:
    """(ts, line) of the log: every request as a JSON line, six of ten spoilt."""
    text = F.to_json(F.struct(*[F.date_format("ts", logs.TIMESTAMP_FORMAT).alias("ts") if c == "ts" else F.col(c) for c in ("request_id", "ts", "user_id", "crop_id", "score")]))
    kinds = [
        F.substring(text, 1, 30),
        F.regexp_replace(text, '"score":[^,}]*', '"score":"high"'),
        F.concat(F.lit("["), text, F.lit("]")),
        F.regexp_replace(text, '"request_id":[0-9]+,', ""),
        F.lit(" \t "),
        F.regexp_replace(text, '"request_id":([0-9]+)', '"request_id":{"id":$1}'),
    ]
    line = text
    for digit, spoilt in enumerate(kinds):
        line = F.when(F.col("request_id") % 10 == digit, spoilt).otherwise(line)
    return inference_log(spark, base).select("ts", line.alias("line"))


def _show(good: DataFrame, rejected: DataFrame) -> DataFrame:
    user = F.coalesce(F.get_json_object("line", "$.user_id").cast("bigint"), F.lit(-1))
    none = lambda name, kind: F.lit(-1).cast(kind).alias(name)
    kept = good.select(F.lit("good").alias("kind"), "request_id", F.unix_micros("ts").alias("ts_us"), "user_id", "score", F.lit("").alias("reason"))
    return kept.unionByName(rejected.select(F.lit("rejected").alias("kind"), none("request_id", "bigint"), none("ts_us", "bigint"), user.alias("user_id"), none("score", "double"), "reason"))


@query("log_rejects", _SQL)
def log_rejects(spark: SparkSession, base: str) -> DataFrame:
    path = f"{work_path(spark, 'log-rejects')}/inference"
    _spoilt(spark, base).select("line").write.text(path)
    return _show(*rejects.split_log(rejects.read_lines(spark, path), logs.INFERENCE_SCHEMA, REQUIRED))


@query("stream_log_rejects", _SQL)
def stream_log_rejects(spark: SparkSession, base: str) -> DataFrame:
    """The log grows between two runs of the stream; records and rejects are those of the ledger's batches."""
    root = work_path(spark, "stream-rejects")
    lines = _spoilt(spark, base)
    for late in (False, True):
        part = F.col("ts") >= F.lit(HALF_WAY)
        lines.filter(part if late else ~part).select("line").write.mode("append").text(f"{root}/inference")
        write = rejects.routed_sink(f"{root}/routed", logs.INFERENCE_SCHEMA, REQUIRED)
        runs.for_each_batch(rejects.stream_lines(spark, f"{root}/inference"), write, f"{root}/checkpoint")
    counted = rejects.ledger(spark, f"{root}/routed").agg(F.sum("lines").alias("n"), F.sum(F.col("good") + F.col("rejected")).alias("m")).first()
    if counted.n != counted.m or counted.n != lines.count():
        raise ValueError(f"{counted.n} lines in the ledger, {counted.m} good and rejected ones")
    return _show(*rejects.read_routed(spark, f"{root}/routed", logs.INFERENCE_SCHEMA))
