"""A hot key holding a large share of the rows must not end in one task."""

import pytest
from pyspark.sql import functions as F

from furrow.operators.feedback import training_samples
from furrow.operators.prefix import rewrite_by_rule_table

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def tight(spark):
    old = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(frame):
    query = frame._jdf.queryExecution()
    frame._jdf.collectToPython()
    return query.executedPlan().toString()


def test_hot_request_is_split(tight):
    requests = tight.range(5000).select(
        F.col("id").alias("request_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.lit(1).cast("bigint").alias("user_id"), F.lit(1).cast("bigint").alias("crop_id"), F.lit(0.5).alias("score"),
    )
    reactions = tight.range(0, 120_000, 1, 12).select(
        F.col("id").alias("feedback_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("request_id"),
        (F.lit("2024-01-01 00:30:00").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 60)).alias("ts"),
        F.lit(1).cast("bigint").alias("user_id"), (F.col("id") % 2).cast("int").alias("rating"),
    )
    frame = training_samples(requests, reactions, "1 HOUR")
    assert "skew=true" in final_plan(frame)
    assert frame.count() == 5000 and frame.filter("label is not null").count() == 5000


def test_hot_path_is_split_when_rules_are_large(tight):
    texts = tight.range(0, 60_000, 1, 12).select(
        "id", F.when(F.col("id") % 3 == 0, "hot/x").otherwise(F.concat(F.lit("k"), F.col("id") % 900, F.lit("/y"))).alias("text")
    )
    rules = tight.range(900).select(F.concat(F.lit("k"), "id").alias("old"), F.concat(F.lit("n"), "id").alias("new"), F.lit(0).alias("ord"))
    rules = rules.union(tight.range(1).select(F.lit("hot"), F.lit("cold"), F.lit(0)))
    frame = rewrite_by_rule_table(texts, "text", rules, max_bytes=0)
    assert "skew=true" in final_plan(frame)
    assert frame.filter("rewritten = 'cold/x'").count() == 20_000
    assert frame.filter("matched_rule is null").count() == 0
