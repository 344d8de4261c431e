"""Trend forecasts, rolling-origin backtests, blending and evaluation.

Series frames have one row per key and month: key columns, `t` (months since
1970) and a decimal `value`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.functions.keys import join_with_nulls
from furrow.operators import boosting
from furrow.session import broadcast_if_small

MEMBERS = ("trend", "last", "mean")
# Spark's trainer of boosted trees keeps about 170 bytes a row in memory; from here on it would read spilled rows again and again.
IN_MEMORY_ROWS = 2_000_000


def _sums(over=None):
    t, v = F.col("t").cast("decimal(12,0)"), F.col("value")
    parts = {
        "n": F.count("value"),
        "st": F.sum(t),
        "sv": F.sum(v),
        "stt": F.sum(t * t),
        "stv": F.sum(t * v),
    }
    return {name: column.over(over) if over is not None else column for name, column in parts.items()}


def fit_trend(series: DataFrame, key: Sequence[str]) -> DataFrame:
    """Line per key from mergeable sums: (key, n, last_t, slope, intercept)."""
    sums = series.groupBy(*key).agg(
        *[column.alias(name) for name, column in _sums().items()], F.max("t").alias("last_t")
    )
    n = F.col("n").cast("decimal(12,0)")
    slope, intercept = exact.fit_line(n, F.col("st"), F.col("sv"), F.col("stt"), F.col("stv"))
    return sums.select(*key, "n", "last_t", slope.alias("slope"), intercept.alias("intercept"))


def forecast_trend(models: DataFrame, key: Sequence[str], horizon: int) -> DataFrame:
    """The next `horizon` months of every fitted line."""
    steps = F.sequence(F.lit(1), F.lit(horizon))
    return models.filter(F.col("slope").isNotNull()).select(
        *key, "last_t", "slope", "intercept", F.explode(steps).alias("step")
    ).select(
        *key,
        (F.col("last_t") + F.col("step")).alias("t"),
        (F.col("intercept") + F.col("slope") * (F.col("last_t") + F.col("step")).cast("double")).alias("forecast"),
    )


def backtest_wide(series: DataFrame, key: Sequence[str], horizon: int = 3, min_history: int = 3) -> DataFrame:
    """Rolling-origin forecasts, one column per member: (key, t, cutoff, actual, *MEMBERS).

    A month t is scored for every cut-off in (t - horizon, t]; each sees only
    months before it. The training sums are running sums over the key's months, added
    once and looked up by every step, so history is never joined to cut-offs and all
    steps share one sort.
    """
    order = Window.partitionBy(*key).orderBy("t")
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = _sums(so_far)
    parts = [*[column.alias(name) for name, column in sums.items()], F.last("value").over(so_far).alias("latest")]
    running = series.select(*key, "t", "value", F.struct(*parts).alias("_sums"))
    steps = []
    for step in range(horizon):
        past = order.rangeBetween(Window.unboundedPreceding, -(step + 1))
        steps.append(F.struct(F.lit(step).alias("step"), F.last("_sums").over(past).alias("_past")))
    rows = running.select(*key, "t", "value", F.array(*steps).alias("steps")).select(*key, "t", "value", F.inline("steps"))
    # Without an earlier month nothing has been counted.
    known = {name: F.col(f"_past.{name}") for name in [*sums, "latest"]} | {"n": F.coalesce("_past.n", F.lit(0))}
    rows = rows.select(*key, "t", "value", "step", *[column.alias(name) for name, column in known.items()])
    n = F.col("n").cast("decimal(12,0)")
    slope, intercept = exact.fit_line(n, F.col("st"), F.col("sv"), F.col("stt"), F.col("stv"))
    return rows.filter(F.col("n") >= min_history).select(
        *key,
        "t",
        (F.col("t") - F.col("step")).alias("cutoff"),
        exact.wide(F.col("value")).alias("actual"),
        (intercept + slope * exact.wide(F.col("t"))).alias("trend"),
        exact.wide(F.col("latest")).alias("last"),
        exact.ratio(F.col("sv"), F.col("n")).alias("mean"),
    )


def to_long(wide: DataFrame) -> DataFrame:
    """One row per member; members without a forecast drop out."""
    rest = [c for c in wide.columns if c not in MEMBERS]
    return wide.unpivot(rest, list(MEMBERS), "member", "forecast").filter(F.col("forecast").isNotNull())


def backtest(series: DataFrame, key: Sequence[str], horizon: int = 3, min_history: int = 3) -> DataFrame:
    """Rolling-origin forecasts as (key, t, cutoff, actual, member, forecast)."""
    return to_long(backtest_wide(series, key, horizon, min_history))


def evaluate(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE, RMSE, MAPE, R2 and bias for every level of rollup(by); totals show as 'ALL', null keys as '(none)'.

    Errors are added as decimals, so the report does not depend on partitioning.
    """
    error = F.col("forecast") - F.col("actual")
    rows = scored.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in by],
        exact.decimal(F.abs(error), 8, 24).alias("abs_error"),
        exact.decimal(error, 8, 24).alias("error"),
        exact.decimal(error * error, 8, 28).alias("squared"),
        exact.decimal(F.abs(F.try_divide(error, F.col("actual"))), 8, 24).alias("relative"),
        exact.decimal(F.col("actual"), 6, 18).alias("actual"),
    )
    fine = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("abs_error").alias("sa"),
        F.sum("error").alias("se"),
        F.sum("squared").alias("ss"),
        F.sum("relative").alias("sr"),
        F.count("relative").alias("nr"),
        F.sum("actual").alias("sy"),
        F.sum(F.col("actual") * F.col("actual")).alias("syy"),
    )
    # Totals add up the groups, so the rows are read for one level only.
    measures = [c for c in fine.columns if c not in by]
    sums = fine.rollup(*by).agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in measures])
    n = exact.wide(F.col("n"))
    spread = exact.wide(F.col("syy")) - exact.wide(F.col("sy")) * exact.wide(F.col("sy")) / n
    return sums.select(
        *[F.coalesce(F.col(c), F.lit("ALL")).alias(c) for c in by],
        F.col("level").cast("int").alias("level"),
        "n",
        (exact.wide(F.col("sa")) / n).alias("mae"),
        F.sqrt(exact.wide(F.col("ss")) / n).alias("rmse"),
        exact.ratio(F.col("sr"), F.col("nr")).alias("mape"),
        (F.lit(1.0) - F.try_divide(exact.wide(F.col("ss")), spread)).alias("r2"),
        (exact.wide(F.col("se")) / n).alias("bias"),
    )


def blend_weights(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weight per group and member, inversely to its mean absolute error."""
    sums = wide.groupBy(*by).agg(
        *[F.sum(exact.decimal(F.abs(F.col(m) - F.col("actual")), 8, 24)).alias(f"_sum_{m}") for m in MEMBERS],
        *[F.count(m).alias(f"_n_{m}") for m in MEMBERS],
    )
    inverse = {m: F.coalesce(exact.ratio(F.col(f"_n_{m}"), F.col(f"_sum_{m}")), F.lit(0.0)) for m in MEMBERS}
    total = sum(inverse.values(), F.lit(0.0))
    return sums.select(*by, *[F.try_divide(inverse[m], total).alias(f"w_{m}") for m in MEMBERS])


def blend(wide: DataFrame, weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted member forecasts; the rows stay where they are when the weights are small."""
    terms = [F.coalesce(F.col(m), F.lit(0.0)) * F.col(f"w_{m}") for m in MEMBERS]
    joined = join_with_nulls(wide, broadcast_if_small(weights), by)
    return joined.withColumn("blended", sum(terms[1:], terms[0]))


def train_global(features: DataFrame, inputs: Sequence[str], label: str, seed: int = 7, **params) -> PipelineModel:
    """One boosted regression over all keys. It is fitted on rows without an empty input and forecasts every row."""
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="keep")
    settings = {"maxIter": 20, "maxDepth": 5, "subsamplingRate": 1.0, **params}
    booster = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="forecast", seed=seed, **settings)
    rows = features.dropna(subset=[*inputs, label])
    # Beyond what Spark's trainer holds in memory the same trees are grown over blocks; other settings are left to it.
    alike = set(settings) <= {"maxIter", "maxDepth", "maxBins", "stepSize", "subsamplingRate"} and settings["subsamplingRate"] == 1.0
    n = rows.count() if alike and booster.getMaxBins() <= 255 else 0
    if n <= IN_MEMORY_ROWS:
        return Pipeline(stages=[assembler, booster]).fit(rows)
    return PipelineModel([assembler, boosting.fit(rows, inputs, label, booster, n)])


def _gram(rows: DataFrame, inputs: Sequence[str], label: str, by: Sequence[str]) -> DataFrame:
    """Counts, sums and products of inputs and label per group: exact decimals, added where the rows lie."""
    names = [*inputs, label]
    values = [exact.decimal(F.col(c), 6).alias(f"x{i}") for i, c in enumerate(names)]
    whole = rows.dropna(subset=names).select(*by, *values)
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(len(names))]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(len(inputs)) for j in range(i, len(names))]
    return whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def fit_ridge(rows: DataFrame, inputs: Sequence[str], label: str, by: Sequence[str] = (), penalty: float = 1.0) -> DataFrame:
    """Ridge regression per group, or one over all rows: (by, n, intercept, one coefficient per input).

    Rows with an empty input or label are left out; no rows give no model. Values count to
    the millionth. The Gram matrix is a mergeable sum, so nothing is sampled and no group
    meets in one task; the centred system, with `penalty` on its diagonal, is solved in the
    group's own row by a Cholesky factor. A positive penalty keeps it solvable.
    """
    if penalty <= 0:
        raise ValueError("the penalty must be positive")
    p = len(inputs)
    wide = lambda name: exact.wide(F.col(name))
    n = exact.wide(F.col("n"))
    centred = {f"a{i}_{j}": wide(f"q{i}_{j}") - wide(f"s{i}") * wide(f"s{j}") / n for i in range(p) for j in range(i, p + 1)}
    for i in range(p):
        centred[f"a{i}_{i}"] = centred[f"a{i}_{i}"] + F.lit(penalty)
    means = {f"m{i}": wide(f"s{i}") / n for i in range(p + 1)}
    solved = _gram(rows, inputs, label, by).filter("n > 0").withColumns(centred | means)
    # Each step only reads columns of earlier ones, so no expression is written out twice.
    less = lambda start, terms: F.col(start) - sum(terms[1:], terms[0]) if terms else F.col(start)
    for j in range(p):
        solved = solved.withColumn(f"l{j}_{j}", F.sqrt(less(f"a{j}_{j}", [F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") for k in range(j)])))
        # The label's column takes part like one more row of the factor: that solves the first triangle.
        solved = solved.withColumns({f"l{i}_{j}": less(f"a{j}_{i}", [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)]) / F.col(f"l{j}_{j}") for i in range(j + 1, p + 1)})
    for i in reversed(range(p)):
        solved = solved.withColumn(f"b{i}", less(f"l{p}_{i}", [F.col(f"l{k}_{i}") * F.col(f"b{k}") for k in range(i + 1, p)]) / F.col(f"l{i}_{i}"))
    lines = [F.col(f"b{i}") * F.col(f"m{i}") for i in range(p)]
    return solved.select(*by, "n", less(f"m{p}", lines).alias("intercept"), *[F.col(f"b{i}").alias(c) for i, c in enumerate(inputs)])


def forecast_ridge(rows: DataFrame, models: DataFrame, inputs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`rows` with `forecast`; null where an input is empty or the group has no model. Values count to the millionth."""
    line = lambda intercept, slopes: sum([slope * exact.wide(exact.decimal(F.col(c), 6)) for c, slope in slopes.items()], intercept)
    if not by:
        # One row, as many numbers as inputs.
        found = models.first()
        if found is None:
            return rows.withColumn("forecast", F.lit(None).cast("double"))
        return rows.withColumn("forecast", line(F.lit(found["intercept"]), {c: F.lit(found[c]) for c in inputs}))
    renamed = models.select(*by, *[F.col(c).alias(f"_{c}") for c in ("intercept", *inputs)])
    joined = join_with_nulls(rows, broadcast_if_small(renamed), by, "left")
    return joined.withColumn("forecast", line(F.col("_intercept"), {c: F.col(f"_{c}") for c in inputs})).drop(*[f"_{c}" for c in ("intercept", *inputs)])
