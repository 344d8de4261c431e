"""Releases published from the tables, with jobs that stop on the way.

Every nation is a run with a manifest and files that follow from its customers' orders.
The first tree is published whole, the second by a job that stops before its commit and
is finished later, the third by a job that stops in its copy and is undone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import trees
from furrow.operators.manifests import MANIFEST_NAME, REGISTRY_NAME
from furrow.plans.registry import query
from furrow.session import work_path
from furrow.sources import snapshots, versions
from furrow.sources.tables import table


class Stopped(RuntimeError):
    """Stands for a driver that is lost."""


def _stop_at(wanted: str):
    def step(name: str) -> None:
        if name == wanted:
            raise Stopped(name)

    return step


def write_tree(spark: SparkSession, base: str, root: str, turn: int, calm: bool = False) -> None:
    """The tree of one turn: others have other texts and lose the models of another third of the runs.

    Of `calm` trees only every fourth run has a manifest, and nothing else names the turn.
    """
    orders = table(spark, base, "orders").select("o_custkey", "o_totalprice")
    homes = table(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    totals = (
        orders.join(homes, "o_custkey")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("total"))
    )
    nations = table(spark, base, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("run_id"))
    texts = {
        MANIFEST_NAME: F.when(F.lit(not calm) | (F.col("c_nationkey") % 4 == 0), F.concat(F.lit('{"orders":'), "n", F.lit(f',"turn":{turn}}}'))),
        "data/total.csv": F.concat(F.lit("total\n"), "total", F.lit("\n")),
        "models/région.bin": F.when((F.col("c_nationkey") + turn) % 3 != 0, F.repeat(F.lit("é"), (F.col("n") % 100).cast("int") + (0 if calm else turn))),
        "_state/.mark": F.lit(""),
    }
    files = F.array(*[F.struct(F.lit(name).alias("name"), text.alias("text")) for name, text in texts.items()])
    rows = totals.join(nations, "c_nationkey").select("run_id", F.inline(files)).filter("text is not null")
    rows = rows.select(F.concat_ws("/", "run_id", "name").alias("rel_path"), "text")
    registry = spark.range(1).select(F.lit(REGISTRY_NAME).alias("rel_path"), F.lit(f'{{"turn":{0 if calm else turn}}}').alias("text"))
    snapshots.write_text_files(rows.union(registry), root)


@query(
    "release_versions",
    f"""
WITH t AS (SELECT n_nationkey AS k, n_name AS run_id, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total
           FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
f AS (
  SELECT run_id || '/{MANIFEST_NAME}' AS rel_path, '{{"orders":' || n || ',"turn":1}}' AS text FROM t
  UNION ALL SELECT run_id || '/data/total.csv', 'total' || chr(10) || total || chr(10) FROM t
  UNION ALL SELECT run_id || '/models/région.bin', repeat('é', n % 100 + 1) FROM t WHERE (k + 1) % 3 <> 0
  UNION ALL SELECT run_id || '/_state/.mark', '' FROM t
  UNION ALL SELECT '{REGISTRY_NAME}', '{{"turn":1}}')
SELECT rel_path, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS sha256, CAST(2 AS INTEGER) AS number, '1,1,2,2' AS seen FROM f
""",
)
def release_versions(spark: SparkSession, base: str) -> DataFrame:
    """What is in force at the end, with the numbers that a reader saw after every job."""
    root = work_path(spark, "release-versions")
    home, seen = f"{root}/home", []
    for turn, stop in ((0, None), (1, "sealed"), (2, "copied")):
        write_tree(spark, base, f"{root}/source-{turn}", turn)
        try:
            versions.publish(spark, f"{root}/source-{turn}", home, on_step=_stop_at(stop))
        except Stopped:
            seen.append(versions.current(spark, home).number)
            versions.recover(spark, home)
        seen.append(versions.current(spark, home).number)
    release = versions.current(spark, home)
    shown = ",".join(map(str, seen[:3] + seen[-1:]))
    return versions.contents(spark, home, release).select("*", F.lit(release.number).alias("number"), F.lit(shown).alias("seen"))


def _turn_sql(turn: int) -> str:
    return f"""
  SELECT run_id || '/{MANIFEST_NAME}' AS path, '{{"orders":' || n || ',"turn":{turn}}}' AS text FROM t WHERE k % 4 = 0
  UNION ALL SELECT run_id || '/data/total.csv', 'total' || chr(10) || total || chr(10) FROM t
  UNION ALL SELECT run_id || '/models/région.bin', repeat('é', n % 100) FROM t WHERE (k + {turn}) % 3 <> 0
  UNION ALL SELECT run_id || '/_state/.mark', '' FROM t
  UNION ALL SELECT '{REGISTRY_NAME}', '{{"turn":0}}'"""


@query(
    "tree_plan",
    f"""
WITH t AS (SELECT n_nationkey AS k, n_name AS run_id, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total
           FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
s AS ({_turn_sql(1)}),
g AS ({_turn_sql(0)}),
plan AS (SELECT coalesce(s.path, g.path) AS path, CASE WHEN g.path IS NULL THEN 'upload' WHEN s.path IS NULL THEN 'delete' ELSE 'update' END AS action
         FROM s FULL JOIN g ON g.path = s.path WHERE g.path IS NULL OR s.path IS NULL OR s.text <> g.text),
-- The root, every run with a difference, and the folders of models that come or go.
opened AS (SELECT count(DISTINCT split_part(path, '/', 1)) + 1 + count(*) FILTER (path LIKE '%/models/%') AS n FROM plan)
SELECT path, action, CAST(n AS BIGINT) AS opened FROM plan, opened
""",
)
def tree_plan(spark: SparkSession, base: str) -> DataFrame:
    """The plan between two published trees that share most folders."""
    root, nodes = work_path(spark, "tree-plan"), []
    for turn in (1, 0):
        source = f"{root}/source-{turn}"
        write_tree(spark, base, source, turn, calm=True)
        versions.publish(spark, source, f"{root}/home-{turn}")
        nodes.append(trees.tree_nodes(versions.contents(spark, f"{root}/home-{turn}")))
    plan, opened = trees.compare_trees(*nodes)
    return plan.withColumn("opened", F.lit(opened).cast("bigint"))
