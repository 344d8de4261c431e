"""Active release, completeness and lifecycle. Orders stand for runs, customers for projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import manifests, releases
from furrow.plans.manifests import LAYOUT, run_listing, run_manifests
from furrow.plans.registry import query
from furrow.sources.tables import table

AS_OF = "2002-01-01"


def _runs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders").select(
        F.col("o_custkey").alias("project"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("metric"),
        (F.col("o_orderstatus") == "F").alias("complete"),
        F.floor("o_totalprice").cast("bigint").alias("size_bytes"),
    )


@query(
    "active_release",
    """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) AS rn
           FROM orders WHERE o_orderstatus = 'F'),
l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey AS project, 'champion' AS policy, o_orderkey AS run_id, o_totalprice AS metric FROM c WHERE rn = 1
UNION ALL SELECT o_custkey, 'latest', o_orderkey, o_totalprice FROM l WHERE rn = 1
""",
)
def active_release(spark: SparkSession, base: str) -> DataFrame:
    return releases.active_release(_runs(spark, base))


@query(
    "release_gaps",
    """
WITH p AS (
  SELECT o_orderkey, coalesce(bool_or(l_linenumber = 1), false) AS has_model, coalesce(bool_or(l_linenumber = 3), false) AS has_csv
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'run' || CAST(o_orderkey AS VARCHAR) AS run_id,
       CAST(1 + (NOT has_model)::INT + (NOT has_csv)::INT AS INTEGER) AS n_missing,
       concat_ws(',', CASE WHEN NOT has_model THEN 'model_dir' END, CASE WHEN NOT has_csv THEN 'recommendation_csv' END,
                 'training_report') AS missing
FROM p
""",
)
def release_gaps(spark: SparkSession, base: str) -> DataFrame:
    runs = run_manifests(spark, base)
    artifacts = manifests.artifact_table(runs, run_listing(spark, base), LAYOUT)
    return releases.missing_artifacts(runs, artifacts, ["model_dir", "recommendation_csv", "training_report"])


_LIFECYCLE_SQL = f"""
WITH r AS (
  SELECT o_custkey AS project, o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CAST(o_orderdate AS DATE) AS d,
         lead(o_orderkey) OVER w AS superseded_by, lead(CAST(o_orderdate AS DATE)) OVER w AS next_d,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
report AS (
  SELECT project, run_id, size_bytes, CAST(DATE '{AS_OF}' - d AS INTEGER) AS age_days, coalesce(superseded_by, -1) AS superseded_by,
         CAST(coalesce(next_d - d, -1) AS INTEGER) AS days_active, newest <= 3 OR DATE '{AS_OF}' - d <= 365 AS keep
  FROM r)"""


def _report(spark: SparkSession, base: str) -> DataFrame:
    return releases.lifecycle(_runs(spark, base), AS_OF, keep=3, max_age_days=365)


@query("lifecycle", _LIFECYCLE_SQL + "\nSELECT * FROM report")
def lifecycle(spark: SparkSession, base: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return _report(spark, base).select(
        "project", "run_id", "size_bytes", "age_days", none("superseded_by"), none("days_active"), "keep"
    )


@query(
    "lifecycle_summary",
    _LIFECYCLE_SQL
    + """
SELECT project, count(*) AS n_runs, count(*) FILTER (keep) AS n_keep,
       CAST(coalesce(sum(size_bytes) FILTER (keep), 0) AS BIGINT) AS bytes_keep,
       CAST(coalesce(sum(size_bytes) FILTER (NOT keep), 0) AS BIGINT) AS bytes_expire, max(age_days) AS oldest_days
FROM report GROUP BY 1
""",
)
def lifecycle_summary(spark: SparkSession, base: str) -> DataFrame:
    return releases.lifecycle_summary(_report(spark, base))
