"""Probability calibration and its metrics. Inputs have `score` in [0,1] and `label` 0/1."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.operators.order import running_totals
from furrow.session import persist_reliably


def score_table(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """Counts per score, exact or rounded to `digits`."""
    score = F.col("score") if digits is None else exact.decimal(F.col("score"), digits)
    return (
        scored.select(score.alias("score"), "label")
        .groupBy("score")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pos"))
    )


def fit_isotonic(scored: DataFrame, digits: int | None = None) -> IsotonicRegressionModel:
    """Monotone map from score to probability, fitted on the weighted score table.

    Each range of scores is pooled on its own first; only the pooled blocks meet.
    """
    rows = score_table(scored, digits).select(
        exact.wide(F.col("score")).alias("score"),
        exact.ratio(F.col("n_pos"), F.col("n")).alias("rate"),
        exact.wide(F.col("n")).alias("weight"),
    )
    return IsotonicRegression(
        featuresCol="score", labelCol="rate", weightCol="weight", predictionCol="probability"
    ).fit(rows)


@dataclass(frozen=True)
class LogisticLine:
    """Log odds as a line over the score, how many Newton steps it took and whether they settled."""

    slope: float
    intercept: float
    steps: int
    settled: bool

    @property
    def coefficients(self) -> list[float]:
        return [self.slope]

    def probability(self, score: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(self.slope * score + F.lit(self.intercept))))


def _logistic_sums(counts: DataFrame, slope: float, intercept: float) -> Row:
    """Deviance, gradient and Hessian of a line: sums over distinct scores, whatever the number of rows."""
    line = F.lit(slope) * F.col("score") + F.lit(intercept)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-line))
    miss, weight = F.col("n_pos") - F.col("n") * p, F.col("n") * p * (F.lit(1.0) - p)
    # log(1 + exp(line)) without overflow.
    log_sum = F.greatest(line, F.lit(0.0)) + F.log1p(F.exp(-F.abs(line)))
    s = F.col("score")
    parts = {"deviance": F.col("n") * log_sum - F.col("n_pos") * line, "g0": miss, "g1": miss * s, "h00": weight, "h01": weight * s, "h11": weight * s * s}
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in parts.items()]).first()


def fit_logistic(scored: DataFrame, tolerance: float = 1e-10, max_steps: int = 50) -> LogisticLine:
    """The line of largest likelihood for log odds, by Newton steps from zero, halved while they make things worse.

    Rows with a null score or label, or a score that is no number, are left out. Without
    two distinct scores the slope is zero; without both labels too, and the intercept is
    that of the share with one row of half a positive added. Labels that a score parts
    altogether have no finite line: the steps then end at `max_steps`, unsettled. Each
    step reads the table of distinct scores once.
    """
    usable = scored.select(F.col("score").cast("double").alias("score"), "label").filter("score is not null and not isnan(score) and label is not null")
    counts = persist_reliably(score_table(usable))
    facts = counts.agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"), F.count(F.lit(1)).alias("scores")).first()
    if facts.scores < 2 or facts.n_pos in (0, facts.n):
        n, n_pos = facts.n or 0, facts.n_pos or 0
        share = n_pos / n if 0 < n_pos < n else (n_pos + 0.5) / (n + 1)
        return LogisticLine(0.0, log(share / (1 - share)), 0, True)
    slope = intercept = 0.0
    now = _logistic_sums(counts, slope, intercept)
    for step in range(1, max_steps + 1):
        det = now.h00 * now.h11 - now.h01 * now.h01
        if det <= 0:
            break
        up, along = (now.h11 * now.g0 - now.h01 * now.g1) / det, (now.h00 * now.g1 - now.h01 * now.g0) / det
        share, after = 1.0, None
        while share > 1e-6:
            after = _logistic_sums(counts, slope + share * along, intercept + share * up)
            if after.deviance <= now.deviance * (1 + 1e-12) + 1e-12:
                break
            share /= 2
        slope, intercept, now = slope + share * along, intercept + share * up, after
        if max(abs(up), abs(along)) * share <= tolerance * max(1.0, abs(slope), abs(intercept)):
            return LogisticLine(slope, intercept, step, True)
    return LogisticLine(slope, intercept, max_steps, False)


def reliability_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins: count, mean score, observed rate and their gap."""
    index = F.greatest(F.lit(0), F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))).cast("int")
    return (
        scored.select(index.alias("bin"), exact.decimal(F.col("score"), 6).alias("s"), "label")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("ss"), F.sum("label").alias("pos"))
        .select(
            "bin",
            "n",
            exact.ratio(F.col("ss"), F.col("n")).alias("mean_score"),
            exact.ratio(F.col("pos"), F.col("n")).alias("rate"),
        )
        .withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected and largest gap over the reliability bins (one row)."""
    return bins.agg(
        exact.ratio(F.sum(exact.decimal(F.col("gap") * F.col("n"), 6, 34)), F.sum("n")).alias("ece"),
        F.max("gap").alias("max_gap"),
    )


def brier_score(scored: DataFrame) -> DataFrame:
    gap = F.col("score") - F.col("label")
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        exact.ratio(F.sum(exact.decimal(gap * gap, 8)), F.count(F.lit(1))).alias("brier"),
    )


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by ranks, ties counted half (one row).

    Rows collapse to distinct scores first; the running count over them is
    range-partitioned, so no task sees them all.
    """
    counts = (
        scored.groupBy("score")
        .agg(F.sum("label").cast("bigint").alias("pos"), F.count(F.lit(1)).alias("n"))
        .withColumn("neg", F.col("n") - F.col("pos"))
    )
    ranked = running_totals(counts, ["score"], {"neg_below": "neg"})
    wide_pos = F.col("pos").cast("decimal(20,0)")
    doubled = F.sum(wide_pos * (F.col("neg_below") * 2 + F.col("neg")).cast("decimal(18,0)"))
    return ranked.agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.try_divide(
            exact.wide(doubled), F.lit(2.0) * exact.wide(F.sum("pos")) * exact.wide(F.sum("neg"))
        ).alias("auc"),
    )


def calibration_report(scored: DataFrame, bins: int = 10) -> DataFrame:
    """All metrics in one row: n, n_pos, n_neg, brier, ece, max_gap, auc."""
    parts = [brier_score(scored), calibration_error(reliability_bins(scored, bins)), auc(scored)]
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("n", "n_pos", "n_neg", "brier", "ece", "max_gap", "auc")])
