"""Feedback logs in batch and as streams, and chart series.

Views stand for inference, purchases for positive and errors for negative
feedback. Feedback names its request by how many events it lies back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import feedback, series
from furrow.plans.registry import query
from furrow.plans.standins import EVENT_NUMBER_SQL, PRICE_SERIES_SQL, amount, event_number, families, lines, month_sql, price_series
from furrow.session import work_path
from furrow.sources import logs
from furrow.sources.tables import table
from furrow.streaming import feedback as streams
from furrow.streaming import runs

BOUND = "2 HOURS"
DELAY = "1 hour"
# The stream queries read a log that grows at this time of the data.
HALF_WAY = "2024-01-15 00:00:00"


def inference_log(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        event_number().cast("bigint").alias("crop_id"),
        F.col("value").alias("score"),
    )


def feedback_log(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").alias("feedback_id"),
        (F.col("event_id") - event_number()).alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("rating"),
    )


_LOGS_SQL = f"""
WITH inference AS (SELECT event_id AS request_id, ts, user_id, {EVENT_NUMBER_SQL} AS crop_id, value AS score
                   FROM events WHERE event_type = 'view'),
feedback AS (SELECT event_id AS feedback_id, event_id - {EVENT_NUMBER_SQL} AS request_id, ts,
                    CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS rating
             FROM events WHERE event_type IN ('purchase', 'error')),
pairs AS (SELECT i.request_id, f.ts AS feedback_ts, f.rating,
                 row_number() OVER (PARTITION BY i.request_id ORDER BY f.ts, f.feedback_id) AS rn
          FROM inference i JOIN feedback f ON f.request_id = i.request_id AND f.ts >= i.ts AND f.ts <= i.ts + INTERVAL 2 HOUR),
samples AS (SELECT i.*, p.feedback_ts, CASE WHEN p.rating > 0 THEN 1 WHEN p.rating IS NOT NULL THEN 0 END AS label
            FROM inference i LEFT JOIN pairs p ON p.request_id = i.request_id AND p.rn = 1)"""

_SAMPLES_SQL = (
    _LOGS_SQL
    + """
SELECT request_id, epoch_us(ts) AS ts_us, user_id, CAST(crop_id AS BIGINT) AS crop_id, score,
       coalesce(epoch_us(feedback_ts), -1) AS feedback_us, coalesce(label, -1) AS label
FROM samples"""
)


def _show(samples: DataFrame) -> DataFrame:
    return samples.select(
        "request_id",
        F.unix_micros("ts").alias("ts_us"),
        "user_id",
        "crop_id",
        "score",
        F.coalesce(F.unix_micros("feedback_ts"), F.lit(-1)).alias("feedback_us"),
        F.coalesce("label", F.lit(-1)).alias("label"),
    )


def _samples(spark: SparkSession, base: str) -> DataFrame:
    return feedback.training_samples(inference_log(spark, base), feedback_log(spark, base), BOUND)


@query("training_samples", _SAMPLES_SQL)
def training_samples(spark: SparkSession, base: str) -> DataFrame:
    return _show(_samples(spark, base))


@query(
    "event_dedupe",
    """
SELECT event_id, epoch_us(ts) AS ts_us, event_type FROM events
""",
)
def event_dedupe(spark: SparkSession, base: str) -> DataFrame:
    """The log with late copies of every purchase, cleaned again."""
    events = table(spark, base, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    late = events.filter(F.col("event_type") == "purchase").withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
    unique = feedback.dedupe_events(events.union(late), "event_id")
    return unique.select("event_id", F.unix_micros("ts").alias("ts_us"), "event_type")


@query(
    "training_summary",
    _LOGS_SQL
    + """,
x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN score < 10 THEN 'low' ELSE 'high' END AS band, label FROM samples),
g AS (SELECT day, band, grouping_id(day, band) AS level, count(*) AS n, count(label) AS n_labelled, coalesce(sum(label), 0) AS n_positive
      FROM x GROUP BY CUBE (day, band))
SELECT coalesce(day, 'ALL') AS day, coalesce(band, 'ALL') AS band, CAST(level AS INTEGER) AS level, n, n_labelled,
       CAST(n_positive AS BIGINT) AS n_positive, CAST(n_labelled AS DOUBLE) / n AS label_rate,
       coalesce(CAST(n_positive AS DOUBLE) / nullif(n_labelled, 0), -1) AS positive_rate
FROM g
""",
)
def training_summary(spark: SparkSession, base: str) -> DataFrame:
    banded = _samples(spark, base).withColumn("band", F.when(F.col("score") < 10, "low").otherwise("high"))
    out = feedback.training_summary(banded, ["band"])
    return out.withColumn("positive_rate", F.coalesce("positive_rate", F.lit(-1.0)))


@query(
    "competition_overview",
    f"""
WITH picks AS (SELECT coalesce(r_name, 'NONE') AS region, {EVENT_NUMBER_SQL} AS crop_id
               FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey
               LEFT JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT region, crop_id, count(*) AS n FROM picks GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY region) AS total, row_number() OVER (PARTITION BY region ORDER BY n DESC, crop_id) AS rn FROM c)
SELECT region, CAST(max(total) AS BIGINT) AS n_picks, count(*) AS n_crops, max(crop_id) FILTER (rn = 1) AS lead_crop,
       CAST(max(n) AS DOUBLE) / CAST(max(total) AS DOUBLE) AS lead_share,
       CAST(sum(n * n) AS DOUBLE) / (CAST(max(total) AS DOUBLE) * CAST(max(total) AS DOUBLE)) AS concentration
FROM t GROUP BY 1
""",
)
def competition_overview(spark: SparkSession, base: str) -> DataFrame:
    homes = (
        table(spark, base, "customer")
        .select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
        .join(table(spark, base, "nation"), "n_nationkey")
        .join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("user_id", F.col("r_name").alias("region"))
    )
    # Users' picks are counted first: the join moves one row per user and crop.
    counts = table(spark, base, "events").groupBy("user_id", event_number().alias("crop_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    picks = counts.join(homes, "user_id", "left").withColumn("region", F.coalesce("region", F.lit("NONE")))
    return feedback.competition_overview(picks, weight="n")


_FACTS_SQL = """
WITH f AS (SELECT (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS t, p_type AS family, n_regionkey AS region_id,
                  CAST(l_extendedprice AS DECIMAL(18,2)) AS v
           FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
           JOIN nation ON n_nationkey = s_nationkey)"""

# The names in the test tables, for the SQL side.
_FAMILIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _facts(spark: SparkSession, base: str) -> DataFrame:
    return lines(spark, base).join(families(spark, base), "crop_id").select("t", "family", "region_id", amount().alias("v"))


@query(
    "chart_pivot",
    _FACTS_SQL
    + f"""
SELECT {month_sql('t')} AS month, {", ".join(f"CAST(coalesce(sum(v) FILTER (family = '{n}'), 0) AS DOUBLE) AS {n.lower()}" for n in _FAMILIES)},
       CAST(sum(v) AS DOUBLE) AS total FROM f GROUP BY t
""",
)
def chart_pivot(spark: SparkSession, base: str) -> DataFrame:
    # Each name is a column, so there are few; all of them are taken.
    names = sorted(r.family for r in families(spark, base).select("family").distinct().collect() if r.family is not None)
    return series.pivot_by_month(_facts(spark, base), "family", names, "v")


@query(
    "chart_running",
    _FACTS_SQL
    + f""",
m AS (SELECT family, t, sum(v) AS v FROM f GROUP BY 1, 2)
SELECT family, {month_sql('t')} AS month, CAST(v AS DOUBLE) AS value,
       CAST(sum(v) OVER (PARTITION BY family ORDER BY t) AS DOUBLE) AS running FROM m
""",
)
def chart_running(spark: SparkSession, base: str) -> DataFrame:
    return series.running_series(_facts(spark, base), "family", "v")


@query(
    "chart_gap_free",
    f"""
WITH {PRICE_SERIES_SQL},
k AS (SELECT crop_id, t, value, lead(t) OVER w AS next_t, lead(value) OVER w AS next_v FROM series WINDOW w AS (PARTITION BY crop_id ORDER BY t)),
m AS (SELECT *, unnest(range(t, coalesce(next_t, t + 1))) AS s FROM k),
d AS (SELECT crop_id, CAST(s AS INTEGER) AS t, s = t AS observed, CAST(value AS DOUBLE) AS last_value,
             CASE WHEN s = t THEN CAST(value AS DOUBLE)
                  ELSE CAST(value AS DOUBLE) + CAST(s - t AS DOUBLE) / CAST(next_t - t AS DOUBLE) * (CAST(next_v AS DOUBLE) - CAST(value AS DOUBLE)) END AS interpolated
      FROM m)
SELECT *, coalesce(lag(interpolated, 1) OVER w, -1) AS month_lag_1, coalesce(lag(interpolated, 12) OVER w, -1) AS month_lag_12
FROM d WINDOW w AS (PARTITION BY crop_id ORDER BY t)
""",
)
def chart_gap_free(spark: SparkSession, base: str) -> DataFrame:
    """Monthly prices without gaps, and lags by month rather than by row."""
    dense = series.gap_free(price_series(spark, base), ["crop_id"])
    lagged = series.month_lags(dense, ["crop_id"], (1, 12)).withColumn("last_value", F.col("last_value").cast("double"))
    return lagged.withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("month_lag_1", "month_lag_12")})


@query(
    "chart_subtotals",
    _FACTS_SQL
    + """,
x AS (SELECT CAST(family AS VARCHAR) AS family, CAST(region_id AS VARCHAR) AS region_id, CAST(t // 12 + 1970 AS VARCHAR) AS year, v FROM f)
SELECT coalesce(family, 'ALL') AS family, coalesce(region_id, 'ALL') AS region_id, coalesce(year, 'ALL') AS year,
       CAST(grouping_id(family, region_id, year) AS INTEGER) AS level, count(*) AS n, CAST(sum(v) AS DOUBLE) AS value
FROM x GROUP BY GROUPING SETS ((family, year), (region_id, year), (family), ())
""",
)
def chart_subtotals(spark: SparkSession, base: str) -> DataFrame:
    facts = _facts(spark, base).withColumn("year", (F.floor(F.col("t") / 12) + 1970))
    sets = [["family", "year"], ["region_id", "year"], ["family"], []]
    return series.subtotals(facts, sets, ["family", "region_id", "year"], "v")


@query("stream_training_samples", _SAMPLES_SQL)
def stream_training_samples(spark: SparkSession, base: str) -> DataFrame:
    """Both logs as JSON lines with repeated lines, read as streams in several batches while they grow, de-duplicated and joined."""
    root = work_path(spark, "stream-samples")
    inference_path, feedback_path = f"{root}/inference", f"{root}/feedback"
    requests, reactions = inference_log(spark, base), feedback_log(spark, base)
    repeated = requests.union(requests.filter(F.col("score") < 5))

    def pairs(read: Callable[[str, str], DataFrame]) -> DataFrame:
        asked = streams.unique_events(read(inference_path, logs.INFERENCE_SCHEMA), "request_id", DELAY)
        answered = streams.unique_events(read(feedback_path, logs.FEEDBACK_SCHEMA), "feedback_id", DELAY)
        return streams.labelled_pairs(asked, answered, BOUND)

    for late in (False, True):
        part = F.col("ts") >= F.lit(HALF_WAY)
        logs.append_log(repeated.filter(part if late else ~part), inference_path)
        logs.append_log(reactions.filter(part if late else ~part), feedback_path)
        stream = pairs(lambda path, schema: logs.stream_log(spark, path, schema))
        runs.append_to_parquet(stream, f"{root}/pairs", f"{root}/checkpoint")
    rest = pairs(lambda path, schema: logs.read_log(spark, path, schema))
    closed = streams.close_bounded(spark.read.parquet(f"{root}/pairs"), rest, ["request_id"])
    return _show(streams.settle(closed))


@query("stream_first_labels", _SAMPLES_SQL)
def stream_first_labels(spark: SparkSession, base: str) -> DataFrame:
    """Both logs as streams that grow between two runs; join and first feedback are two stateful steps of one stream."""
    root = work_path(spark, "stream-labels")
    inference_path, feedback_path = f"{root}/inference", f"{root}/feedback"
    requests, reactions = inference_log(spark, base), feedback_log(spark, base)

    def samples(read: Callable[[str, str], DataFrame]) -> DataFrame:
        marked = [read(path, schema).withWatermark("ts", DELAY) for path, schema in ((inference_path, logs.INFERENCE_SCHEMA), (feedback_path, logs.FEEDBACK_SCHEMA))]
        return streams.first_labels(*marked, BOUND)

    for late in (False, True):
        part = F.col("ts") >= F.lit(HALF_WAY)
        logs.append_log(requests.filter(part if late else ~part), inference_path)
        logs.append_log(reactions.filter(part if late else ~part), feedback_path)
        runs.append_to_parquet(samples(lambda path, schema: logs.stream_log(spark, path, schema)), f"{root}/samples", f"{root}/checkpoint")
    whole = samples(lambda path, schema: logs.read_log(spark, path, schema))
    return _show(streams.close_bounded(spark.read.parquet(f"{root}/samples"), whole, ["request_id"]))


@query(
    "stream_daily_counts",
    """
SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events WHERE event_type = 'view' GROUP BY 1, 2
""",
)
def stream_daily_counts(spark: SparkSession, base: str) -> DataFrame:
    """A log that grows between two runs of the stream, then closed."""
    root = work_path(spark, "stream-daily")
    path = f"{root}/inference"
    requests = inference_log(spark, base)
    counts = lambda log: streams.daily_counts(log, "user_id", "score", DELAY)
    for late in (False, True):
        part = F.col("ts") >= F.lit(HALF_WAY)
        logs.append_log(requests.filter(part if late else ~part), path)
        runs.append_to_parquet(counts(logs.stream_log(spark, path, logs.INFERENCE_SCHEMA)), f"{root}/counts", f"{root}/checkpoint")
    emitted = spark.read.parquet(f"{root}/counts")
    closed = streams.close_bounded(emitted, counts(logs.read_log(spark, path, logs.INFERENCE_SCHEMA)), ["day", "user_id"])
    return closed.withColumn("total", F.col("total").cast("double"))


@query(
    "stream_sample_sinks",
    """
SELECT sink, event_id AS request_id, epoch_us(ts) AS ts_us, user_id, value AS score
FROM events, (VALUES ('csv'), ('json')) v(sink) WHERE event_type = 'view'
""",
)
def stream_sample_sinks(spark: SparkSession, base: str) -> DataFrame:
    """A log with repeated lines, de-duplicated as a stream into JSON lines and CSV at once."""
    root = work_path(spark, "stream-sinks")
    path = f"{root}/inference"
    requests = inference_log(spark, base)
    logs.append_log(requests.union(requests.filter(F.col("score") > 20)), path)
    stream = streams.unique_events(logs.stream_log(spark, path, logs.INFERENCE_SCHEMA), "request_id", DELAY)
    runs.for_each_batch(stream, streams.two_sinks(f"{root}/json", f"{root}/csv"), f"{root}/checkpoint")
    as_json = logs.read_log(spark, f"{root}/json", logs.INFERENCE_SCHEMA).withColumn("sink", F.lit("json"))
    as_csv = logs.read_csv(spark, f"{root}/csv", logs.INFERENCE_SCHEMA).withColumn("sink", F.lit("csv"))
    return as_json.unionByName(as_csv).select("sink", "request_id", F.unix_micros("ts").alias("ts_us"), "user_id", "score")
