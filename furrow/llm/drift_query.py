"""Query op11_drift_clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm.drift_clusters import CLUSTERS, LARGEST, ROUNDS, cluster
from furrow.llm.registry import query
from furrow.sources.tables import table

_START_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e) AND abs(e) <= {LARGEST // 64}]) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS id, x FROM v
  QUALIFY id < {CLUSTERS})"""


def _assignment_sql(turn: int) -> str:
    """Every vector to its nearest centroid of this turn."""
    return f"""
a{turn} AS MATERIALIZED (
  SELECT r, vec_id, x, arg_min(id, d * {CLUSTERS} + id) AS cluster, min(d) AS d
  FROM (SELECT v.r, v.vec_id, v.x, c.id, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)]) AS BIGINT) AS d FROM v, c{turn} c)
  GROUP BY r, vec_id, x)"""


def _move_sql(turn: int) -> str:
    """Every non-empty centroid to the floor of its vectors' mean."""
    return f"""
m{turn} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x
  FROM (SELECT cluster, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS n FROM a{turn - 1}, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2)
  GROUP BY 1),
c{turn} AS MATERIALIZED (SELECT id, coalesce(m.x, c.x) AS x FROM c{turn - 1} c LEFT JOIN m{turn} m ON m.cluster = c.id)"""


_SQL = (
    ",".join([_START_SQL, _assignment_sql(0), *[part for turn in range(1, ROUNDS + 1) for part in (_move_sql(turn), _assignment_sql(turn))]])
    + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.id = cluster
"""
)


@query("op11_drift_clusters", _SQL)
def op11_drift_clusters(spark: SparkSession, base: str) -> DataFrame:
    return cluster(table(spark, base, "embeddings")).drop("scanned")
