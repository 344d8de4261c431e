"""Profit, mapping, features, forecasts, backtests and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.functions.calendar import month_label, year_of
from furrow.operators import features, forecast, nearest
from furrow.plans.registry import query
from furrow.plans.standins import (
    OBSERVATIONS_SQL,
    PRICE_SERIES_SQL,
    families,
    month_sql,
    observations,
    price_series,
    units,
)
from furrow.session import persist_reliably
from furrow.sources.tables import table


@query(
    "market_observations",
    f"""
WITH {OBSERVATIONS_SQL}
SELECT crop_id, region_id, {month_sql('t')} AS month, CAST(revenue AS DOUBLE) / CAST(units AS DOUBLE) AS price,
       CAST(units AS DOUBLE) AS yield, CAST(cost AS DOUBLE) AS cost
FROM obs
""",
)
def market_observations(spark: SparkSession, base: str) -> DataFrame:
    return observations(spark, base).select(
        "crop_id",
        "region_id",
        month_label(F.col("t")).alias("month"),
        exact.ratio(F.col("revenue"), F.col("units")).alias("price"),
        exact.wide(F.col("units")).alias("yield"),
        exact.wide(F.col("cost")).alias("cost"),
    )


@query(
    "profit_join",
    f"""
WITH {OBSERVATIONS_SQL},
c AS (SELECT crop_id, region_id, t, CAST(revenue AS DOUBLE) / CAST(units AS DOUBLE) AS price,
             CAST(units AS DOUBLE) AS yield, CAST(cost AS DOUBLE) AS cost FROM obs)
SELECT crop_id, region_id, {month_sql('t')} AS month, price, yield, cost, price * yield AS revenue,
       price * yield - cost AS profit
FROM c
""",
)
def profit_join(spark: SparkSession, base: str) -> DataFrame:
    """Three sources, taken from one stored table of observations, meet on their cell."""
    cells = [F.col("crop_id"), F.col("region_id"), F.col("t").alias("period")]
    stored = persist_reliably(observations(spark, base))
    prices = stored.select(*cells, exact.ratio(F.col("revenue"), F.col("units")).alias("price"))
    yields = stored.select(*cells, exact.wide(F.col("units")).alias("yield"))
    costs = stored.select(*cells, exact.wide(F.col("cost")).alias("cost"))
    joined = features.assemble_profit(prices, yields, costs)
    return joined.withColumn("month", month_label(F.col("period"))).drop("period")


@query(
    "profit_cube",
    f"""
WITH {OBSERVATIONS_SQL},
c AS (SELECT r_name AS region, p_type AS family, CAST(t // 12 + 1970 AS VARCHAR) AS year, revenue, cost
      FROM obs JOIN region ON region_id = r_regionkey JOIN part ON p_partkey = crop_id)
SELECT coalesce(region, 'ALL') AS region, coalesce(family, 'ALL') AS family, coalesce(year, 'ALL') AS year,
       CAST(grouping_id(region, family, year) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n_cells, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(cost) AS DOUBLE) AS cost,
       CAST(sum(revenue - cost) AS DOUBLE) AS profit
FROM c GROUP BY ROLLUP (region, family, year)
""",
)
def profit_cube(spark: SparkSession, base: str) -> DataFrame:
    regions = table(spark, base, "region").select(
        F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region")
    )
    cells = (
        observations(spark, base)
        .join(regions, "region_id")
        .join(families(spark, base), "crop_id")
        .withColumn("year", year_of(F.col("t")))
    )
    return features.profit_rollup(cells, ["region", "family", "year"])


_SOURCE_NAME_SQL = "' ' || upper(p_name) || CASE WHEN p_size > 25 THEN '  ' ELSE '' END"
_MAPPED = "p_type IN ('ECONOMY', 'LARGE') AND p_size < 10"


@query(
    "mapping_conform",
    f"""
WITH mapping AS (SELECT lower(trim(p_name)) AS name_key, min(p_partkey) AS crop_id FROM part WHERE {_MAPPED} GROUP BY 1),
source AS (SELECT lower(trim({_SOURCE_NAME_SQL})) AS name_key, l_quantity
           FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT name_key, coalesce(crop_id, -1) AS crop_id, crop_id IS NULL AS unmapped, count(*) AS n_rows,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM source LEFT JOIN mapping USING (name_key) GROUP BY ALL
""",
)
def mapping_conform(spark: SparkSession, base: str) -> DataFrame:
    parts = table(spark, base, "part").select("p_partkey", "p_name", "p_type", "p_size")
    mapping = parts.filter(_MAPPED).select(F.col("p_name").alias("source_name"), F.col("p_partkey").alias("crop_id"))
    name = F.concat(F.lit(" "), F.upper("p_name"), F.when(F.col("p_size") > 25, "  ").otherwise(""))
    source = (
        table(spark, base, "lineitem")
        .select("l_partkey", "l_quantity")
        .join(parts.select(F.col("p_partkey").alias("l_partkey"), name.alias("source_name")), "l_partkey")
    )
    return (
        features.conform(source, mapping)
        .groupBy("name_key", "crop_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), exact.wide(F.sum(units())).alias("quantity"))
        .select(
            "name_key",
            F.coalesce("crop_id", F.lit(-1)).alias("crop_id"),
            F.col("crop_id").isNull().alias("unmapped"),
            "n_rows",
            "quantity",
        )
    )


@query(
    "mapping_unmapped",
    f"""
SELECT lower(trim({_SOURCE_NAME_SQL})) AS name_key, count(*) AS n_rows
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE lower(trim({_SOURCE_NAME_SQL})) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE {_MAPPED})
GROUP BY 1
""",
)
def mapping_unmapped(spark: SparkSession, base: str) -> DataFrame:
    parts = table(spark, base, "part")
    mapping = parts.filter(_MAPPED).select(F.col("p_name").alias("source_name"))
    name = F.concat(F.lit(" "), F.upper("p_name"), F.when(F.col("p_size") > 25, "  ").otherwise(""))
    source = (
        table(spark, base, "lineitem")
        .select("l_partkey")
        .join(parts.select(F.col("p_partkey").alias("l_partkey"), name.alias("source_name")), "l_partkey")
    )
    return features.unmapped(source, mapping)


def _frame(k: int) -> str:
    return f"(PARTITION BY crop_id ORDER BY t ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _rolling_sql(k: int) -> str:
    return f"""
       CAST(sum(value) OVER {_frame(k)} AS DOUBLE) / count(value) OVER {_frame(k)} AS mean_{k},
       CASE WHEN count(value) OVER {_frame(k)} > 1 THEN sqrt(
         CAST(count(value) OVER {_frame(k)} * sum(CAST(value * value AS DECIMAL(30,4))) OVER {_frame(k)}
              - sum(value) OVER {_frame(k)} * sum(value) OVER {_frame(k)} AS DOUBLE)
         / CAST(count(value) OVER {_frame(k)} * (count(value) OVER {_frame(k)} - 1) AS DOUBLE)) END AS std_{k}"""


_KNOWN_SQL = "lower(trim(p_name)) || ' ' || lower(p_brand)"
_SPELT_SQL = f"""CASE p_partkey % 4
           WHEN 0 THEN left(k, CAST(p_size % 9 AS INTEGER)) || substr(k, CAST(p_size % 9 + 2 AS INTEGER))
           WHEN 1 THEN left(k, CAST(p_size % 7 AS INTEGER)) || 'xy' || substr(k, CAST(p_size % 7 + 1 AS INTEGER))
           WHEN 2 THEN left(k, CAST(p_size % 8 AS INTEGER)) || 'q' || substr(k, CAST(p_size % 8 + 2 AS INTEGER)) || '#'
           ELSE k || ' of the old sort' END"""


@query(
    "mapping_nearest",
    f"""
WITH p AS (SELECT p_partkey, p_size, {_KNOWN_SQL} AS k FROM part),
known AS (SELECT DISTINCT k FROM p WHERE p_size < 25),
spelt AS (SELECT DISTINCT {_SPELT_SQL} AS name FROM p)
SELECT name, k AS candidate, CAST(levenshtein(name, k) AS INTEGER) AS distance
FROM spelt, known WHERE abs(length(name) - length(k)) <= 2 AND levenshtein(name, k) <= 2
""",
)
def mapping_nearest(spark: SparkSession, base: str) -> DataFrame:
    """Misspelt source names with the mapped names within two edits."""
    name = F.concat(F.lower(F.trim("p_name")), F.lit(" "), F.lower("p_brand"))
    parts = table(spark, base, "part").select("p_partkey", "p_size", name.alias("k"))
    cut = lambda n, skip: (F.substring(F.col("k"), F.lit(1), F.col("p_size") % n), F.substring(F.col("k"), F.col("p_size") % n + 1 + skip, F.char_length("k")))
    dropped, doubled, changed = cut(9, 1), cut(7, 0), cut(8, 1)
    turn = F.col("p_partkey") % 4
    spelt = (
        F.when(turn == 0, F.concat(*dropped))
        .when(turn == 1, F.concat(doubled[0], F.lit("xy"), doubled[1]))
        .when(turn == 2, F.concat(changed[0], F.lit("q"), changed[1], F.lit("#")))
        .otherwise(F.concat("k", F.lit(" of the old sort")))
    )
    return nearest.nearest_names(parts.select(spelt.alias("name")), parts.filter("p_size < 25").select(F.col("k").alias("name")))


_FEATURES_SQL = f"""
WITH {PRICE_SERIES_SQL},
f AS (
  SELECT crop_id, t, CAST(t // 12 + 1970 AS INTEGER) AS year, CAST(t % 12 + 1 AS INTEGER) AS month,
         CAST(value AS DOUBLE) AS price,
         CAST(lag(value, 1) OVER w AS DOUBLE) AS lag_1, CAST(lag(value, 3) OVER w AS DOUBLE) AS lag_3,
         CAST(lag(value, 12) OVER w AS DOUBLE) AS lag_12, {_rolling_sql(3)}, {_rolling_sql(12)}
  FROM series WINDOW w AS (PARTITION BY crop_id ORDER BY t))"""


@query(
    "lag_features",
    _FEATURES_SQL
    + """
SELECT crop_id, t, year, month, price, coalesce(lag_1, -1) AS lag_1, coalesce(lag_3, -1) AS lag_3,
       coalesce(lag_12, -1) AS lag_12, coalesce(mean_3, -1) AS mean_3, coalesce(std_3, -1) AS std_3,
       coalesce(mean_12, -1) AS mean_12, coalesce(std_12, -1) AS std_12,
       coalesce((price - lag_1) / nullif(lag_1, 0), -9) AS growth
FROM f
""",
)
def lag_features(spark: SparkSession, base: str) -> DataFrame:
    out = _features(spark, base)
    missing = lambda c, v: F.coalesce(exact.wide(F.col(c)), F.lit(v)).alias(c)
    filled = ["lag_1", "lag_3", "lag_12", "mean_3", "std_3", "mean_12", "std_12"]
    return out.select(
        "crop_id", "t", "year", "month", exact.wide(F.col("price")).alias("price"),
        *[missing(c, -1.0) for c in filled], missing("growth", -9.0),
    )


def _features(spark: SparkSession, base: str) -> DataFrame:
    return features.lag_features(price_series(spark, base).withColumnRenamed("value", "price"), ["crop_id"])


@query(
    "trend_forecast",
    f"""
WITH {PRICE_SERIES_SQL},
s AS (SELECT crop_id, CAST(count(*) AS DECIMAL(12,0)) AS n, max(t) AS last_t, sum(CAST(t AS DECIMAL(12,0))) AS st,
             sum(value) AS sv, sum(CAST(CAST(t AS BIGINT) * t AS DECIMAL(18,0))) AS stt, sum(CAST(t AS DECIMAL(12,0)) * value) AS stv
      FROM series GROUP BY 1),
m AS (SELECT *, CAST(CAST(n AS INTEGER) * stv - CAST(st AS INTEGER) * sv AS DOUBLE) AS top,
             CAST(CAST(n AS INTEGER) * stt - CAST(st AS INTEGER) * CAST(st AS INTEGER) AS DOUBLE) AS bottom FROM s),
l AS (SELECT *, top / bottom AS slope, (CAST(sv AS DOUBLE) - top / bottom * CAST(st AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept
      FROM m WHERE bottom <> 0)
SELECT crop_id, last_t + h AS t, intercept + slope * CAST(last_t + h AS DOUBLE) AS forecast
FROM l, (VALUES (1), (2), (3)) v(h)
""",
)
def trend_forecast(spark: SparkSession, base: str) -> DataFrame:
    models = forecast.fit_trend(price_series(spark, base), ["crop_id"])
    return forecast.forecast_trend(models, ["crop_id"], horizon=3)


_SCORED_SQL = f"""
WITH {PRICE_SERIES_SQL},
grid AS (SELECT a.crop_id, a.t, a.t - h AS cutoff, a.value AS actual FROM series a, (VALUES (0), (1), (2)) v(h)),
past AS (
  SELECT g.crop_id, g.t, g.cutoff, any_value(CAST(g.actual AS DOUBLE)) AS actual, count(*) AS n,
         sum(s.t) AS st, sum(s.value) AS sv, sum(s.t * s.t) AS stt,
         sum(CAST(s.t AS DECIMAL(12,0)) * s.value) AS stv, arg_max(s.value, s.t) AS latest
  FROM grid g JOIN series s ON s.crop_id = g.crop_id AND s.t < g.cutoff
  GROUP BY 1, 2, 3 HAVING count(*) >= 3),
m AS (SELECT *, CAST(n * stv - st * sv AS DOUBLE) AS top, CAST(n * stt - st * st AS DOUBLE) AS bottom FROM past),
l AS (SELECT *, top / bottom AS slope, (CAST(sv AS DOUBLE) - top / bottom * CAST(st AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept FROM m),
scored AS (
  SELECT crop_id, t, cutoff, actual, 'trend' AS member, intercept + slope * CAST(t AS DOUBLE) AS forecast FROM l WHERE bottom <> 0
  UNION ALL SELECT crop_id, t, cutoff, actual, 'last', CAST(latest AS DOUBLE) FROM l
  UNION ALL SELECT crop_id, t, cutoff, actual, 'mean', CAST(sv AS DOUBLE) / CAST(n AS DOUBLE) FROM l)"""


def _wide(spark: SparkSession, base: str) -> DataFrame:
    return forecast.backtest_wide(price_series(spark, base), ["crop_id"], horizon=3)


def _wide_by_family(spark: SparkSession, base: str) -> DataFrame:
    return _wide(spark, base).join(families(spark, base), "crop_id")


@query("backtest", _SCORED_SQL + "\nSELECT crop_id, t, cutoff, actual, member, forecast FROM scored")
def backtest(spark: SparkSession, base: str) -> DataFrame:
    return forecast.to_long(_wide(spark, base))


@query(
    "eval_report",
    _SCORED_SQL
    + """,
e AS (SELECT member, p_type AS family, CAST(abs(forecast - actual) AS DECIMAL(24,8)) AS a,
             CAST(forecast - actual AS DECIMAL(24,8)) AS e,
             CAST((forecast - actual) * (forecast - actual) AS DECIMAL(28,8)) AS s,
             CAST(abs((forecast - actual) / nullif(actual, 0)) AS DECIMAL(24,8)) AS r, CAST(actual AS DECIMAL(18,6)) AS y
      FROM scored JOIN part ON p_partkey = crop_id),
g AS (SELECT member, family, grouping_id(member, family) AS level, count(*) AS n, sum(a) AS sa, sum(e) AS se, sum(s) AS ss,
             sum(r) AS sr, count(r) AS nr, sum(y) AS sy, sum(CAST(y AS DECIMAL(38,6)) * y) AS syy
      FROM e GROUP BY ROLLUP (member, family))
SELECT coalesce(member, 'ALL') AS member, coalesce(family, 'ALL') AS family, CAST(level AS INTEGER) AS level, n,
       round(CAST(sa AS DOUBLE) / n, 6) AS mae, round(sqrt(CAST(ss AS DOUBLE) / n), 6) AS rmse,
       round(CAST(sr AS DOUBLE) / nr, 6) AS mape,
       round(1.0::DOUBLE - CAST(ss AS DOUBLE) / (CAST(syy AS DOUBLE) - CAST(sy AS DOUBLE) * CAST(sy AS DOUBLE) / n), 9) AS r2,
       round(CAST(se AS DOUBLE) / n, 6) AS bias
FROM g
""",
)
def eval_report(spark: SparkSession, base: str) -> DataFrame:
    scored = forecast.to_long(_wide_by_family(spark, base))
    report = forecast.evaluate(scored, ["member", "family"])
    digits = {"mae": 6, "rmse": 6, "mape": 6, "r2": 9, "bias": 6}
    return report.withColumns({name: F.round(name, d) for name, d in digits.items()})


_WEIGHTS_SQL = """,
err AS (SELECT p_type AS family, member,
               CAST(count(*) AS DOUBLE) / CAST(sum(CAST(abs(forecast - actual) AS DECIMAL(24,8))) AS DOUBLE) AS inv
        FROM scored JOIN part ON p_partkey = crop_id GROUP BY 1, 2),
wide AS (SELECT family, coalesce(max(inv) FILTER (member = 'trend'), 0) AS i_trend,
                coalesce(max(inv) FILTER (member = 'last'), 0) AS i_last,
                coalesce(max(inv) FILTER (member = 'mean'), 0) AS i_mean FROM err GROUP BY 1),
weights AS (SELECT family, i_trend / (i_trend + i_last + i_mean) AS w_trend,
                   i_last / (i_trend + i_last + i_mean) AS w_last, i_mean / (i_trend + i_last + i_mean) AS w_mean FROM wide)"""


@query(
    "blend_weights",
    _SCORED_SQL + _WEIGHTS_SQL
    + "\nSELECT family, round(w_trend, 9) AS w_trend, round(w_last, 9) AS w_last, round(w_mean, 9) AS w_mean FROM weights",
)
def blend_weights(spark: SparkSession, base: str) -> DataFrame:
    weights = forecast.blend_weights(_wide_by_family(spark, base), ["family"])
    return weights.select("family", *[F.round(f"w_{m}", 9).alias(f"w_{m}") for m in forecast.MEMBERS])


@query(
    "blend",
    _SCORED_SQL
    + _WEIGHTS_SQL
    + """,
member_rows AS (SELECT crop_id, p_type AS family, t, cutoff, actual, coalesce(max(forecast) FILTER (member = 'trend'), 0) AS f_trend,
             coalesce(max(forecast) FILTER (member = 'last'), 0) AS f_last,
             coalesce(max(forecast) FILTER (member = 'mean'), 0) AS f_mean
      FROM scored JOIN part ON p_partkey = crop_id GROUP BY 1, 2, 3, 4, 5)
SELECT crop_id, t, cutoff, actual, round(f_trend * w_trend + f_last * w_last + f_mean * w_mean, 6) AS blended
FROM member_rows JOIN weights USING (family)
""",
)
def blend(spark: SparkSession, base: str) -> DataFrame:
    wide = persist_reliably(_wide_by_family(spark, base))
    out = forecast.blend(wide, forecast.blend_weights(wide, ["family"]), ["family"])
    return out.select("crop_id", "t", "cutoff", "actual", F.round("blended", 6).alias("blended"))


# Inputs of the models over all keys, and the month from which they are scored.
INPUTS = ["lag_1", "lag_3", "mean_3", "mean_12", "std_3", "month"]
SPLIT = (2000 - 1970) * 12
PENALTY = 1.0


def _model_rows(spark: SparkSession, base: str) -> DataFrame:
    return _features(spark, base).select(
        "crop_id", "t", exact.wide(F.col("price")).alias("price"), "month",
        *[exact.wide(F.col(c)).alias(c) for c in INPUTS if c != "month"],
    )


@query("global_model")
def global_model(spark: SparkSession, base: str) -> DataFrame:
    """Boosted regression on the lag features; scored on the months after the training span."""
    # Training reads the rows several times, scoring once more.
    rows = persist_reliably(_model_rows(spark, base))
    model = forecast.train_global(rows.filter(F.col("t") < SPLIT), INPUTS, "price")
    return model.transform(rows.filter(F.col("t") >= SPLIT)).select("crop_id", "t", "price", "forecast")


def _ridge_sql(by: str) -> str:
    """Gram sums per group, then the Cholesky factor and both triangles, one common table each."""
    p, names = len(INPUTS), [*INPUTS, "price"]
    values = ", ".join(f"CAST({c} AS DECIMAL(18,6)) AS x{i}" for i, c in enumerate(names))
    sums = ", ".join(f"CAST(sum(x{i}) AS DOUBLE) AS s{i}" for i in range(p + 1))
    products = ", ".join(f"CAST(sum(CAST(x{i} AS DECIMAL(38,6)) * x{j}) AS DOUBLE) AS q{i}_{j}" for i in range(p) for j in range(i, p + 1))
    present = " AND ".join(f"{c} IS NOT NULL" for c in names)
    less = lambda start, terms: f"{start} - ({' + '.join(terms)})" if terms else start
    steps = [", ".join(f"q{i}_{j} - s{i} * s{j} / n{f' + {PENALTY}::DOUBLE' if i == j else ''} AS a{i}_{j}" for i in range(p) for j in range(i, p + 1))]
    steps.append(", ".join(f"s{i} / n AS m{i}" for i in range(p + 1)))
    for j in range(p):
        steps.append(f"sqrt({less(f'a{j}_{j}', [f'l{j}_{k} * l{j}_{k}' for k in range(j)])}) AS l{j}_{j}")
        steps.append(", ".join(f"({less(f'a{j}_{i}', [f'l{i}_{k} * l{j}_{k}' for k in range(j)])}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, p + 1)))
    for i in reversed(range(p)):
        steps.append(f"({less(f'l{p}_{i}', [f'l{k}_{i} * b{k}' for k in range(i + 1, p)])}) / l{i}_{i} AS b{i}")
    steps.append(f"{less(f'm{p}', [f'b{i} * m{i}' for i in range(p)])} AS b")
    tables = [f"d AS (SELECT crop_id, t, {values} FROM f WHERE {present})"]
    tables.append(f"g0 AS (SELECT {by} AS grp, CAST(count(*) AS DOUBLE) AS n, {sums}, {products} FROM d JOIN part ON p_partkey = crop_id WHERE t < {SPLIT} GROUP BY 1)")
    tables += [f"g{i + 1} AS (SELECT *, {step} FROM g{i})" for i, step in enumerate(steps)]
    return f"{_FEATURES_SQL},\n" + ",\n".join(tables) + f",\nridge AS (SELECT * FROM g{len(steps)})"


@query(
    "ridge_coefficients",
    _ridge_sql("p_type")
    + "\nSELECT grp AS family, CAST(n AS BIGINT) AS n, round(b, 6) AS intercept, "
    + ", ".join(f"round(b{i}, 6) AS {c}" for i, c in enumerate(INPUTS))
    + " FROM ridge",
)
def ridge_coefficients(spark: SparkSession, base: str) -> DataFrame:
    """One ridge model per crop family."""
    rows = _model_rows(spark, base).filter(F.col("t") < SPLIT).join(families(spark, base), "crop_id")
    models = forecast.fit_ridge(rows, INPUTS, "price", ["family"], PENALTY)
    return models.select("family", "n", *[F.round(c, 6).alias(c) for c in ("intercept", *INPUTS)])


@query(
    "ridge_forecast",
    _ridge_sql("1")
    + "\nSELECT crop_id, t, CAST(x6 AS DOUBLE) AS price, round(b + "
    + " + ".join(f"b{i} * CAST(x{i} AS DOUBLE)" for i in range(len(INPUTS)))
    + f", 6) AS forecast FROM d, ridge WHERE t >= {SPLIT}",
)
def ridge_forecast(spark: SparkSession, base: str) -> DataFrame:
    """One ridge model over all keys, scored on the months after the training span; rows with all inputs."""
    rows = persist_reliably(_model_rows(spark, base).dropna())
    model = forecast.fit_ridge(rows.filter(F.col("t") < SPLIT), INPUTS, "price", penalty=PENALTY)
    scored = forecast.forecast_ridge(rows.filter(F.col("t") >= SPLIT), model, INPUTS)
    return scored.select("crop_id", "t", "price", F.round("forecast", 6).alias("forecast"))
