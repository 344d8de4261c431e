"""Active release, completeness and lifecycle of many runs.

Run frames have `project`, `run_id`, `created_at` and what an operator names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.keys import join_with_nulls
from furrow.session import broadcast_if_small


def active_release(runs: DataFrame, within: Sequence[str] = ("project",)) -> DataFrame:
    """Per group: `champion` (best metric among complete runs) and `latest` (newest run).

    One mergeable aggregate gives both; ties go to the newer run, then the higher id.
    """
    complete = F.when(F.col("complete"), F.struct("metric", "created_at", "run_id"))
    picks = runs.groupBy(*within).agg(
        F.max(complete).alias("champion"), F.max(F.struct("created_at", "run_id", "metric")).alias("latest")
    )
    return picks.select(
        *within,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(policy).alias("policy"),
                        F.col(f"{policy}.run_id").alias("run_id"),
                        F.col(f"{policy}.metric").alias("metric"),
                    )
                    for policy in ("champion", "latest")
                ]
            )
        ),
    ).filter(F.col("run_id").isNotNull())


def missing_artifacts(runs: DataFrame, artifacts: DataFrame, required: Sequence[str]) -> DataFrame:
    """Runs that lack a required artifact: (run_id, n_missing, missing).

    `runs` lists every run; `artifacts` has (run_id, artifact_key, exists). A run that
    names no artifact lacks them all. A run's result is at most as long as the list of
    required keys.
    """
    needed = F.array(*[F.lit(k) for k in sorted(required)])
    held = artifacts.filter(F.col("exists") & F.col("artifact_key").isin(*required))
    found = held.groupBy("run_id").agg(F.collect_set("artifact_key").alias("found"))
    missing = F.array_except(needed, F.coalesce("found", F.array().cast("array<string>")))
    return (
        runs.select("run_id").distinct().join(found, "run_id", "left")
        .select("run_id", F.size(missing).alias("n_missing"), F.array_join(missing, ",").alias("missing"))
        .filter(F.col("n_missing") > 0)
    )


def with_successor(
    runs: DataFrame, within: Sequence[str], order: Sequence[str], bucket: str, out: str = "next"
) -> DataFrame:
    """The next row of the same group in `order` (which must be unique), as a struct.

    `bucket` is a column that grows with the order, such as a day. Rows look for
    their successor inside their bucket; only the last of a bucket takes the
    head of the next one. So a group of any size is spread over its buckets, and
    the central table has one row per group and bucket.
    """
    entry = F.struct(*order)
    inside = Window.partitionBy(*within, bucket).orderBy(*order)
    heads = runs.groupBy(*within, bucket).agg(F.min(entry).alias("_head"))
    following = Window.partitionBy(*within).orderBy(bucket)
    heads = heads.select(*within, bucket, F.lead("_head").over(following).alias("_next_head"))
    return (
        join_with_nulls(runs.withColumn("_inside", F.lead(entry).over(inside)), heads, [*within, bucket])
        .withColumn(out, F.coalesce("_inside", "_next_head"))
        .drop("_inside", "_next_head")
    )


def lifecycle(runs: DataFrame, as_of: str, keep: int, max_age_days: int, within: Sequence[str] = ("project",)) -> DataFrame:
    """Age, successor and keep/expire flag of every run.

    A run is kept while it is among the `keep` newest of its project or younger
    than `max_age_days`. The limit per project is its `keep`-th newest run,
    found by a top-k that cuts partitions before the shuffle.
    """
    newest = Window.partitionBy(*within).orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    limit = (
        runs.select(*within, "created_at", "run_id")
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= keep)
        .groupBy(*within)
        .agg(F.min(F.struct("created_at", "run_id")).alias("_limit"))
    )
    day = runs.withColumn("_day", F.to_date("created_at"))
    linked = with_successor(day, within, ["created_at", "run_id"], "_day").drop("_day")
    age = F.date_diff(F.lit(as_of).cast("date"), F.to_date("created_at"))
    recent = F.struct("created_at", "run_id") >= F.col("_limit")
    return join_with_nulls(linked, broadcast_if_small(limit), within).select(
        *within,
        "run_id",
        "size_bytes",
        age.alias("age_days"),
        F.col("next.run_id").alias("superseded_by"),
        F.date_diff(F.to_date("next.created_at"), F.to_date("created_at")).alias("days_active"),
        (recent | (age <= max_age_days)).alias("keep"),
    )


def lifecycle_summary(report: DataFrame, within: Sequence[str] = ("project",)) -> DataFrame:
    """Runs and bytes to keep and to expire, per group."""
    kept = F.col("keep")
    return report.groupBy(*within).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(kept).alias("n_keep"),
        F.sum(F.when(kept, F.col("size_bytes")).otherwise(0)).alias("bytes_keep"),
        F.sum(F.when(kept, 0).otherwise(F.col("size_bytes"))).alias("bytes_expire"),
        F.max("age_days").alias("oldest_days"),
    )
