"""A release tree on the shared folder, written from the tables, then scanned and repaired.

Every nation stands for a run. Its manifest carries totals of its customers'
orders, and its files follow from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import manifests
from furrow.operators.environment import repair_tree
from furrow.operators.manifests import ARTIFACT_FILES, MANIFEST_NAME, REGISTRY_NAME, ReleaseLayout
from furrow.plans.registry import query
from furrow.session import work_path
from furrow.sources import snapshots
from furrow.sources.releases import list_files, registry_present, run_files, scan_manifests
from furrow.sources.tables import table

LAYOUT = ReleaseLayout("/srv/app/output/release", "/srv/app/output", "/srv/app")


def _totals(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders").select("o_custkey", "o_totalprice")
    homes = table(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    by_nation = (
        orders.join(homes, "o_custkey")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    )
    nations = table(spark, base, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("run_id"))
    return nations.join(by_nation, "c_nationkey")


def write_source(spark: SparkSession, base: str, root: str) -> None:
    old = F.concat(F.lit("D:\\train\\out\\发布\\"), "run_id")
    document = F.to_json(
        F.struct(
            old.alias("release_dir"),
            F.col("n").alias("n_orders"),
            F.col("total").cast("string").alias("total"),
            F.struct(F.struct(F.concat(old, F.lit("\\x")).alias("path")).alias("model_dir")).alias("artifacts"),
            F.concat(F.lit("D:\\train\\out\\log\\"), "run_id").alias("log"),
        )
    )
    runs = _totals(spark, base)
    file = lambda name, text: F.struct(name.alias("name"), text.alias("text"))
    files = F.array(
        file(F.lit(MANIFEST_NAME), F.when(F.col("c_nationkey") == 24, "{broken").otherwise(document)),
        file(F.lit(ARTIFACT_FILES["model_dir"] + "/part.bin"), F.when(F.col("n") % 2 == 0, "m")),
        file(F.lit(ARTIFACT_FILES["env_model_bundle"]), F.when(F.col("n") % 3 == 0, "e")),
        file(F.lit(ARTIFACT_FILES["recommendation_csv"]), F.lit("region,crop\n")),
        # Hidden, empty and nested ones belong to the tree too.
        file(F.lit("code/__init__.py"), F.lit("")),
        file(F.lit(".dockerignore"), F.lit("*.pyc\n")),
        file(F.lit("_run/_state/.mark"), F.lit("")),
    )
    texts = runs.select("run_id", F.inline(files)).filter(F.col("text").isNotNull()).select(
        F.concat_ws("/", "run_id", "name").alias("rel_path"), "text"
    )
    registry = spark.range(1).select(F.lit(REGISTRY_NAME).alias("rel_path"), F.lit("{}").alias("text"))
    snapshots.write_text_files(texts.union(registry), root)


@query(
    "release_tree_repair",
    """
WITH t AS (SELECT n_nationkey, n_name AS run_id, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total
           FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
r AS (SELECT *, '/srv/app/output/release/' || run_id AS run_dir, n_nationkey <> 24 AS ok FROM t)
SELECT run_id, CASE WHEN ok THEN 'repaired' ELSE 'rejected' END AS state,
       CAST(1 + 1 + 3 + (n % 2 = 0)::INT + (n % 3 = 0)::INT AS BIGINT) AS n_files,
       CASE WHEN ok THEN run_dir ELSE '' END AS release_dir,
       CASE WHEN ok THEN run_dir || '/发布清单.json' ELSE '' END AS manifest_path, '' AS source_output_dir,
       CASE WHEN ok THEN run_dir ELSE '' END AS serving_output_dir,
       CASE WHEN ok AND n % 3 = 0 THEN run_dir || '/环境模型包.pkl' ELSE '' END AS serving_env_model_bundle,
       CASE WHEN ok THEN run_dir || '/推荐结果.csv' ELSE '' END AS serving_recommendations,
       CASE WHEN ok THEN run_dir || '/模型' ELSE '' END AS model_path,
       CASE WHEN ok THEN CAST(n % 2 = 0 AS VARCHAR) ELSE '' END AS model_exists,
       CASE WHEN ok THEN '/srv/app/output/log/' || run_id ELSE '' END AS log,
       CASE WHEN ok THEN total ELSE '' END AS total, 'replaced,kept' AS sync_states
FROM r
""",
)
def release_tree_repair(spark: SparkSession, base: str) -> DataFrame:
    """Write a tree, sync it twice, repair it in place and read it back."""
    root = work_path(spark, "release-tree") + "//whole"
    source, target = f"{root}/source", f"{root}/output/release"
    write_source(spark, base, source)
    states = [snapshots.sync_release(spark, source, target) for _ in range(2)]
    _, rejected = repair_tree(spark, target, LAYOUT)
    if not registry_present(spark, target):
        raise FileNotFoundError(target)
    files = run_files(list_files(spark, target)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_files"))
    found = scan_manifests(spark, target)
    more = {
        "model_path": "$.artifacts.model_dir.path",
        "model_exists": "$.artifacts.model_dir.exists",
        "log": "$.log",
        "total": "$.total",
    }
    view = manifests.manifest_view(found, "document", more)
    bad = rejected.select("run_id", F.lit("rejected").alias("bad"))
    joined = files.join(view, "run_id").join(bad, "run_id", "left")
    texts = [*manifests.VIEW_PATHS, *more]
    return joined.select(
        "run_id",
        F.coalesce("bad", F.lit("repaired")).alias("state"),
        "n_files",
        *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
        F.lit(",".join(states)).alias("sync_states"),
    )
