"""Inference and feedback logs: samples, summaries and concentration of picks.

Inference rows have (request_id, ts, user_id, crop_id, score); feedback rows have
(feedback_id, request_id, ts, rating). The same transformations serve batch and
stream wherever a stream can run them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import exact

SAMPLE_COLUMNS = ["request_id", "ts", "user_id", "crop_id", "score"]


def dedupe_events(events: DataFrame, key: str) -> DataFrame:
    """One row per event id: the earliest copy."""
    rest = [c for c in events.columns if c not in (key, "ts")]
    return (
        events.groupBy(key)
        .agg(F.min(F.struct("ts", *rest)).alias("first"))
        .select(key, "first.*")
        .select(*events.columns)
    )


def within_bound(request_ts: Column, feedback_ts: Column, bound: str) -> Column:
    return (feedback_ts >= request_ts) & (feedback_ts <= request_ts + F.expr(f"INTERVAL {bound}"))


def first_feedback(pairs: DataFrame) -> DataFrame:
    """The earliest feedback of each request, from (request_id, feedback_ts, feedback_id, rating)."""
    return (
        pairs.groupBy("request_id")
        .agg(F.min(F.struct("feedback_ts", "feedback_id", "rating")).alias("first"))
        .select("request_id", "first.feedback_ts", "first.rating")
    )


def training_samples(inference: DataFrame, feedback: DataFrame, bound: str) -> DataFrame:
    """Every request with the label of its first feedback inside the time bound, or none.

    Feedback names its request, so the join key is unique on the request side and
    pairs never outnumber feedback. A request with very many reactions is split
    by the skew join and shrinks in the partial aggregate.
    """
    reactions = feedback.select(
        "request_id", "feedback_id", F.col("ts").alias("feedback_ts"), "rating"
    )
    pairs = (
        inference.select("request_id", "ts")
        .join(reactions, "request_id")
        .filter(within_bound(F.col("ts"), F.col("feedback_ts"), bound))
    )
    labelled = inference.join(first_feedback(pairs), "request_id", "left")
    return labelled.select(*SAMPLE_COLUMNS, "feedback_ts", label(F.col("rating")).alias("label"))


def label(rating: Column) -> Column:
    """1 for a positive rating, 0 for any other, null without feedback."""
    return F.when(rating.isNotNull(), (rating > 0).cast("int"))


def training_summary(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and label rates for all combinations of day and `by`; totals show as 'ALL', null keys as '(none)'."""
    rows = samples.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in by], "label"
    )
    fine = rows.groupBy("day", *by).agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"), F.sum("label").alias("n_positive")
    )
    return (
        fine.cube("day", *by)
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("n").alias("n"),
            F.sum("n_labelled").alias("n_labelled"),
            F.coalesce(F.sum("n_positive"), F.lit(0)).alias("n_positive"),
        )
        .select(
            *[F.coalesce(F.col(c), F.lit("ALL")).alias(c) for c in ("day", *by)],
            "level",
            "n",
            "n_labelled",
            "n_positive",
            exact.ratio(F.col("n_labelled"), F.col("n")).alias("label_rate"),
            exact.ratio(F.col("n_positive"), F.col("n_labelled")).alias("positive_rate"),
        )
    )


def competition_overview(
    picks: DataFrame, region: str = "region", crop: str = "crop_id", weight: str | None = None
) -> DataFrame:
    """Per region: picks, distinct crops, leading crop and its share, concentration.

    Concentration is the sum of squared shares. It needs only the count per
    (region, crop), which is combined before any shuffle. `weight` names a column
    of counts when the picks come pre-counted.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = picks.groupBy(region, crop).agg(amount.alias("n"))
    n = F.col("n").cast("decimal(18,0)")
    return (
        counts.groupBy(region)
        .agg(
            F.sum("n").alias("n_picks"),
            F.count(F.lit(1)).alias("n_crops"),
            F.max(F.struct(F.col("n"), (-F.col(crop)).alias("neg"))).alias("lead"),
            F.sum((n * n).cast("decimal(28,0)")).alias("squares"),
        )
        .select(
            region,
            "n_picks",
            "n_crops",
            (-F.col("lead.neg")).alias("lead_crop"),
            exact.ratio(F.col("lead.n"), F.col("n_picks")).alias("lead_share"),
            (exact.wide(F.col("squares")) / (exact.wide(F.col("n_picks")) * exact.wide(F.col("n_picks")))).alias(
                "concentration"
            ),
        )
    )
