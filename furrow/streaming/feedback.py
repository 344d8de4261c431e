"""Inference and feedback logs as streams.

Append mode emits a row once the watermark has passed it, so the newest rows of a log
stay open while it may grow. `close_bounded` finishes a log that has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.feedback import SAMPLE_COLUMNS, first_feedback, label, within_bound
from furrow.sources.logs import write_csv, write_json


def close_bounded(emitted: DataFrame, whole: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a stream has emitted, and what it still holds back.

    `whole` is the stream's own transformation as a batch over the same log. Neither
    the log nor the stream's checkpoint is touched, so the stream can go on.
    """
    held = whole.join(emitted.select(*key).distinct(), list(key), "left_anti").select(*emitted.columns)
    return emitted.unionByName(held)


def unique_events(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """Each event id once: within the watermark delay in a stream, over the whole log in a batch."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def labelled_pairs(inference: DataFrame, feedback: DataFrame, bound: str) -> DataFrame:
    """Requests with their feedback inside the bound; those without any come with nulls.

    Both streams carry a watermark on `ts`, so the state of a request ends with
    its bound.
    """
    reactions = feedback.select(
        F.col("request_id").alias("feedback_request"), "feedback_id", F.col("ts").alias("feedback_ts"), "rating"
    )
    together = (F.col("request_id") == F.col("feedback_request")) & within_bound(
        F.col("ts"), F.col("feedback_ts"), bound
    )
    return (
        inference.join(reactions, together, "leftOuter")
        .select(*SAMPLE_COLUMNS, "feedback_ts", "feedback_id", "rating")
    )


def first_labels(inference: DataFrame, feedback: DataFrame, bound: str) -> DataFrame:
    """One sample per request, labelled by its first feedback: the join and the minimum in one stream.

    The minimum has its own state: one row per open request, however much feedback the
    request gets, and it closes once the join's watermark has passed the request's bound.
    The join keeps a reaction only until no request that it could belong to can still
    arrive. A batch gives the same rows.
    """
    pairs = labelled_pairs(inference, feedback, bound)
    reaction = F.when(F.col("feedback_id").isNotNull(), F.struct("feedback_ts", "feedback_id", "rating"))
    return (
        pairs.groupBy(*SAMPLE_COLUMNS)
        .agg(F.min(reaction).alias("first"))
        .select(*SAMPLE_COLUMNS, F.col("first.feedback_ts").alias("feedback_ts"), label(F.col("first.rating")).alias("label"))
    )


def settle(pairs: DataFrame) -> DataFrame:
    """Batch step over the pair table: one sample per request, labelled by its first feedback."""
    requests = pairs.groupBy("request_id").agg(F.first(F.struct(*SAMPLE_COLUMNS[1:])).alias("r"))
    first = first_feedback(pairs.filter(F.col("feedback_id").isNotNull()))
    return requests.join(first, "request_id", "left").select(
        "request_id", "r.*", "feedback_ts", label(F.col("rating")).alias("label")
    )


def daily_counts(events: DataFrame, kind: str, value: str, delay: str) -> DataFrame:
    """Events and exact value sums per UTC day and kind."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "n", "total")
    )


def two_sinks(json_path: str, csv_path: str) -> Callable[[DataFrame, int], None]:
    """Writer for training samples: JSON lines and CSV, one folder per batch.

    A repeated batch replaces its own folder, so a retry leaves no duplicates.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        # Kept for the second sink: the stateful part runs once per batch.
        kept = batch.persist()
        try:
            write_json(kept, f"{json_path}/batch={epoch}")
            write_csv(kept, f"{csv_path}/batch={epoch}")
        finally:
            kept.unpersist()

    return write
