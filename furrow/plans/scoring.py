"""Calibration, weighted scores, recommendations, lookups and environment matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.operators import boxes, calibrate, hulls, pivots, recommend
from furrow.plans.registry import query
from furrow.plans.standins import (
    EVENT_NUMBER_SQL,
    OBSERVATIONS_SQL,
    amount,
    charge,
    event_number,
    lines,
    units,
)
from furrow.session import persist_reliably
from furrow.sources.tables import table

_SCORED_SQL = """
WITH scored AS (SELECT doc_id, quality AS label, 1.0::DOUBLE / (1.0::DOUBLE + CAST(n_chars AS DOUBLE) / 2000.0::DOUBLE) AS score
                FROM documents JOIN labels USING (doc_id))"""


def _scored(spark: SparkSession, base: str) -> DataFrame:
    score = F.lit(1.0) / (F.lit(1.0) + F.col("n_chars").cast("double") / F.lit(2000.0))
    docs = table(spark, base, "documents").select("doc_id", score.alias("score"))
    return docs.join(table(spark, base, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


_BINS_SQL = (
    _SCORED_SQL
    + """,
bins AS (
  SELECT bin, n, CAST(ss AS DOUBLE) / n AS mean_score, CAST(pos AS DOUBLE) / n AS rate
  FROM (SELECT CAST(greatest(0, least(floor(score * 10), 9)) AS INTEGER) AS bin, count(*) AS n,
               sum(CAST(score AS DECIMAL(18,6))) AS ss, sum(label) AS pos FROM scored GROUP BY 1))"""
)


@query(
    "calibration_bins",
    _BINS_SQL + "\nSELECT bin, n, mean_score, rate, abs(mean_score - rate) AS gap FROM bins",
)
def calibration_bins(spark: SparkSession, base: str) -> DataFrame:
    return calibrate.reliability_bins(_scored(spark, base))


@query(
    "calibration_metrics",
    _BINS_SQL
    + """,
e AS (SELECT sum(abs(mean_score - rate) * n) / sum(n) AS ece, max(abs(mean_score - rate)) AS max_gap FROM bins),
b AS (SELECT count(*) AS n, avg((score - label) * (score - label)) AS brier FROM scored),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored),
a AS (SELECT sum(label) AS n_pos, sum(1 - label) AS n_neg,
             (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS auc
      FROM r)
SELECT n, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(brier, 6) AS brier, round(ece, 6) AS ece,
       round(max_gap, 6) AS max_gap, round(auc, 9) AS auc
FROM e, b, a
""",
)
def calibration_metrics(spark: SparkSession, base: str) -> DataFrame:
    report = calibrate.calibration_report(_scored(spark, base))
    digits = {"brier": 6, "ece": 6, "max_gap": 6, "auc": 9}
    return report.select("n", "n_pos", "n_neg", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "calibration_isotonic",
    _SCORED_SQL
    + """,
t AS (SELECT score, count(*) AS n, sum(label) AS pos, CAST(sum(count(*)) OVER (ORDER BY score) AS BIGINT) AS cn,
             CAST(sum(sum(label)) OVER (ORDER BY score) AS BIGINT) AS cp FROM scored GROUP BY score),
blocks AS (SELECT a.score AS lo, b.score AS hi, CAST(b.cp - a.cp + a.pos AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean
           FROM t a JOIN t b ON a.score <= b.score),
low AS (SELECT hi AS score, min(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS worst FROM blocks)
SELECT score, n, round(max(worst), 9) AS probability FROM low JOIN t USING (score) GROUP BY score, n
""",
)
def calibration_isotonic(spark: SparkSession, base: str) -> DataFrame:
    points = persist_reliably(calibrate.score_table(_scored(spark, base).filter("score is not null")))
    fitted = hulls.apply_blocks(points, hulls.isotonic_blocks(points))
    return fitted.select("score", "n", F.round("probability", 9).alias("probability"))


@query(
    "calibration_logistic",
    _BINS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """,
t AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY score),
newton(step, a, b) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT step + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT step, a, b, sum(pos - n * p) AS g0, sum((pos - n * p) * score) AS g1, sum(n * p * (1 - p)) AS h00,
               sum(n * p * (1 - p) * score) AS h01, sum(n * p * (1 - p) * score * score) AS h11
        FROM (SELECT step, a, b, score, n, pos, 1 / (1 + exp(-(a + b * score))) AS p FROM newton, t WHERE step < 15)
        GROUP BY step, a, b)),
line AS (SELECT a, b FROM newton WHERE step = 15)
SELECT mean_score AS score, rate, n, round(1 / (1 + exp(-(a + b * mean_score))), 9) AS probability FROM bins, line
""",
)
def calibration_logistic(spark: SparkSession, base: str) -> DataFrame:
    scored = _scored(spark, base)
    steps = calibrate.reliability_bins(scored).select(F.col("mean_score").alias("score"), "rate", "n")
    return steps.withColumn("probability", F.round(calibrate.fit_logistic(scored).probability(F.col("score")), 9))


WEIGHTS = {"profit": 0.5, "volume": 0.3, "cost": -0.2}

_CANDIDATES_SQL = f"""
WITH {OBSERVATIONS_SQL},
c AS (SELECT region_id, crop_id, CAST(sum(revenue - cost) AS DOUBLE) AS profit, CAST(sum(units) AS DOUBLE) AS volume,
             CAST(sum(cost) AS DOUBLE) AS cost FROM obs GROUP BY 1, 2),
x AS (SELECT region_id, min(profit) AS p0, max(profit) AS p1, min(volume) AS v0, max(volume) AS v1, min(cost) AS c0, max(cost) AS c1
      FROM c GROUP BY 1),
s AS (SELECT region_id, crop_id, profit, volume, c.cost,
             CAST(0.5 AS DOUBLE) * coalesce((profit - p0) / nullif(p1 - p0, 0), 0) + CAST(0.3 AS DOUBLE) * coalesce((volume - v0) / nullif(v1 - v0, 0), 0)
             + CAST(0.2 AS DOUBLE) * (1.0::DOUBLE - coalesce((cost - c0) / nullif(c1 - c0, 0), 0)) AS score
      FROM c JOIN x USING (region_id))"""


def _candidates(spark: SparkSession, base: str) -> DataFrame:
    return lines(spark, base).groupBy("region_id", "crop_id").agg(
        exact.wide(F.sum(amount()) - F.sum(charge())).alias("profit"),
        exact.wide(F.sum(units())).alias("volume"),
        exact.wide(F.sum(charge())).alias("cost"),
    )


def _weighted(spark: SparkSession, base: str) -> DataFrame:
    # The candidates are read for their extremes and again for their scores.
    candidates = persist_reliably(_candidates(spark, base))
    return recommend.weighted_score(candidates, WEIGHTS, ["region_id"])


@query("weighted_score", _CANDIDATES_SQL + "\nSELECT region_id, crop_id, profit, volume, cost, score FROM s")
def weighted_score(spark: SparkSession, base: str) -> DataFrame:
    return _weighted(spark, base)


@query(
    "recommend_topk",
    _CANDIDATES_SQL
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY score DESC, crop_id) AS rank FROM s)
SELECT region_id, r_name AS region, crop_id, CAST(rank AS INTEGER) AS rank, score, profit, volume
FROM r JOIN region ON r_regionkey = region_id WHERE rank <= 10
""",
)
def recommend_topk(spark: SparkSession, base: str) -> DataFrame:
    regions = table(spark, base, "region").select(
        F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region")
    )
    best = recommend.top_k(_weighted(spark, base), ["region_id"], k=10)
    return best.join(regions, "region_id").select("region_id", "region", "crop_id", "rank", "score", "profit", "volume")


@query(
    "lookup_fallback",
    _CANDIDATES_SQL
    + f""",
table_rows AS (SELECT region_id, crop_id, score FROM s),
defaults AS (SELECT region_id, max(score) AS best FROM table_rows GROUP BY 1),
q AS (SELECT event_id, {EVENT_NUMBER_SQL} AS crop_id, n_regionkey AS region_id
      FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT event_id, q.crop_id, coalesce(q.region_id, -1) AS region_id, coalesce(t.score, d.best, -1) AS score,
       CASE WHEN t.score IS NOT NULL THEN 'exact' WHEN d.best IS NOT NULL THEN 'default' ELSE 'none' END AS origin
FROM q LEFT JOIN table_rows t ON t.region_id = q.region_id AND t.crop_id = q.crop_id
       LEFT JOIN defaults d ON d.region_id = q.region_id
""",
)
def lookup_fallback(spark: SparkSession, base: str) -> DataFrame:
    precomputed = _weighted(spark, base).select("region_id", "crop_id", "score")
    homes = (
        table(spark, base, "customer")
        .select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
        .join(table(spark, base, "nation"), "n_nationkey", "left")
        .select("user_id", F.col("n_regionkey").alias("region_id"))
    )
    requests = (
        table(spark, base, "events")
        .select("event_id", "user_id", event_number().cast("bigint").alias("crop_id"))
        .join(homes, "user_id", "left")
        .drop("user_id")
    )
    out = recommend.lookup_with_default(requests, precomputed, ["region_id", "crop_id"], ["region_id"], "score")
    return out.select(
        "event_id",
        F.col("crop_id").cast("int").alias("crop_id"),
        F.coalesce("region_id", F.lit(-1)).alias("region_id"),
        F.coalesce("score", F.lit(-1.0)).alias("score"),
        "origin",
    )


_PROFILES_SQL = """
WITH profiles AS (
  SELECT p_brand || '/' || p_type AS crop, floor(CAST(sum(p_size) AS DOUBLE) / count(*)) - 4 AS size_lo,
         floor(CAST(sum(p_size) AS DOUBLE) / count(*)) + 4 AS size_hi,
         floor(CAST(min(p_retailprice) AS DOUBLE)) AS price_lo, floor(CAST(min(p_retailprice) AS DOUBLE)) + 12 AS price_hi
  FROM part GROUP BY 1)"""


def _profiles(spark: SparkSession, base: str) -> DataFrame:
    mean = F.floor(exact.ratio(F.sum("p_size"), F.count(F.lit(1)))).cast("double")
    low = F.floor(F.min("p_retailprice")).cast("double")
    return (
        table(spark, base, "part")
        .groupBy(F.concat_ws("/", "p_brand", "p_type").alias("crop"))
        .agg(
            (mean - 4).alias("size_lo"), (mean + 4).alias("size_hi"), low.alias("price_lo"), (low + 12).alias("price_hi")
        )
    )


@query(
    "env_suitable",
    _PROFILES_SQL
    + """,
q AS (SELECT l_quantity AS size, 900.0::DOUBLE + (l_partkey % 97) AS price, l_shipdate, l_partkey AS request FROM lineitem),
m AS (SELECT q.*, crop FROM q JOIN profiles ON size BETWEEN size_lo AND size_hi AND price BETWEEN price_lo AND price_hi)
SELECT crop, count(*) AS n_requests, count(DISTINCT request) AS n_places, min(price) AS lowest, max(size) AS largest FROM m GROUP BY 1
""",
)
def env_suitable(spark: SparkSession, base: str) -> DataFrame:
    requests = table(spark, base, "lineitem").select(
        F.col("l_quantity").alias("size"),
        (F.lit(900.0) + F.col("l_partkey") % 97).alias("price"),
        F.col("l_partkey").alias("request"),
    )
    profiles = _profiles(spark, base)
    return recommend.profile_matches(
        requests, ["size", "price"], "request", "crop",
        lambda points: recommend.suitable(points, profiles, ["size", "price"], width=4.0),
        F.min("price").alias("lowest"), F.max("size").alias("largest"),
    ).select("crop", "n_requests", "n_places", "lowest", "largest")


@query(
    "env_boxes",
    """
WITH profiles AS (
  SELECT p_brand || '/' || p_type AS crop, min(p_size) AS size_lo, min(p_size) + CASE WHEN count(*) % 3 = 0 THEN 40 ELSE 2 END AS size_hi,
         floor(min(p_retailprice)) AS price_lo, floor(min(p_retailprice)) + CASE WHEN count(*) % 4 = 0 THEN 500 ELSE 6 END AS price_hi,
         0.02::DOUBLE AS tax_lo, CASE WHEN min(p_size) % 2 = 0 THEN 'infinity'::DOUBLE ELSE 0.04::DOUBLE END AS tax_hi
  FROM part GROUP BY 1),
q AS (SELECT l_quantity AS size, 900.0::DOUBLE + (l_partkey % 97) AS price, l_tax AS tax, l_partkey AS request FROM lineitem),
m AS (SELECT q.*, crop FROM q JOIN profiles ON size BETWEEN size_lo AND size_hi AND price BETWEEN price_lo AND price_hi AND tax BETWEEN tax_lo AND tax_hi)
SELECT crop, count(*) AS n_requests, count(DISTINCT request) AS n_places, min(price) AS lowest, max(size) AS largest FROM m GROUP BY 1
""",
)
def env_boxes(spark: SparkSession, base: str) -> DataFrame:
    """Profiles with narrow, wide and open ranges in three factors."""
    price = F.lit(900.0) + F.col("l_partkey") % 97
    requests = table(spark, base, "lineitem").select(F.col("l_quantity").alias("size"), price.alias("price"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("request"))
    n, size, price = F.count(F.lit(1)), F.min("p_size"), F.floor(F.min("p_retailprice"))
    profiles = table(spark, base, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("crop")).agg(
        size.alias("size_lo"),
        (size + F.when(n % 3 == 0, 40).otherwise(2)).alias("size_hi"),
        price.alias("price_lo"),
        (price + F.when(n % 4 == 0, 500).otherwise(6)).alias("price_hi"),
        F.lit(0.02).alias("tax_lo"),
        F.when(size % 2 == 0, float("inf")).otherwise(0.04).alias("tax_hi"),
    )
    factors = ["size", "price", "tax"]
    return recommend.profile_matches(
        requests, factors, "request", "crop", lambda points: boxes.inside_boxes(points, profiles, factors),
        F.min("price").alias("lowest"), F.max("size").alias("largest"),
    ).select("crop", "n_requests", "n_places", "lowest", "largest")


@query(
    "env_neighbours",
    """
WITH q AS (SELECT vec_id AS request, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
pairs AS (SELECT request, vec_id AS crop, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) AS sim FROM embeddings, q WHERE len(embedding) = len(v)),
r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY sim DESC, crop) AS rank FROM pairs)
SELECT request, CAST(rank AS INTEGER) AS rank, crop, round(sim, 6) AS similarity FROM r WHERE rank <= 3
""",
)
def env_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """The closest places to every twentieth, with most of the catalogue skipped by its angle to a pivot."""
    vectors = table(spark, base, "embeddings")
    requests = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("request"), "embedding")
    catalogue = vectors.select(F.col("vec_id").alias("crop"), F.col("embedding").alias("centroid"))
    near = pivots.cosine_top_k_pruned(requests, catalogue, "embedding", "crop", k=3)
    return near.select("request", "rank", "crop", F.round("similarity", 6).alias("similarity"))


@query(
    "env_match",
    """
WITH cells AS (
  SELECT label, pos, CAST(sum(CAST(CAST(embedding[pos] AS DOUBLE) AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean
  FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2),
profiles AS (SELECT label, list(mean ORDER BY pos) AS centroid FROM cells GROUP BY 1),
pairs AS (SELECT e.vec_id, p.label AS crop, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 9) AS sim
          FROM embeddings e, profiles p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, crop) AS rank FROM pairs)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, crop, round(sim, 6) AS similarity FROM r WHERE rank <= 3
""",
)
def env_match(spark: SparkSession, base: str) -> DataFrame:
    vectors = table(spark, base, "embeddings").select("vec_id", F.col("label").alias("crop"), "embedding")
    profiles = recommend.centroids(vectors, "crop", "embedding")
    near = recommend.cosine_top_k(vectors.select("vec_id", "embedding"), profiles, "embedding", "crop", k=3)
    return near.select("vec_id", "rank", "crop", F.round("similarity", 6).alias("similarity"))
