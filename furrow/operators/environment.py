"""The whole preparation job: snapshot sync, manifest repair, settings, summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import manifests, settings
from furrow.operators.payload import malformed
from furrow.session import persist_reliably
from furrow.sources import snapshots
from furrow.sources.releases import list_files, run_files, scan_manifests

# Fixed value: the variable that forces a sync.
FORCE_VARIABLE = "HF_ARTIFACTS_FORCE_DOWNLOAD"


def repair_tree(spark: SparkSession, root: str, layout: manifests.ReleaseLayout) -> tuple[int, DataFrame]:
    """Repair the manifests below `root`; gives the number changed and the rejected ones.

    The repaired texts are on reliable storage before the first file is replaced.
    """
    found = scan_manifests(spark, root)
    listing = run_files(list_files(spark, root))
    repaired = manifests.repair_manifests(found.select("run_id", "document"), listing, layout)
    changed = persist_reliably(repaired.filter("changed").select("run_id", "repaired"))
    rejected = persist_reliably(malformed(found, "document").select("run_id", "path"))
    return snapshots.write_manifest_files(changed, root), rejected


def prepare_environment(
    spark: SparkSession,
    runtime_root: str,
    source: str,
    base_settings: DataFrame,
    environment: DataFrame,
    repo_root: str,
    force: bool = False,
    variables: Mapping[str, str] | None = None,
) -> DataFrame:
    """Bring a release in place and resolve its settings; a one-row summary.

    `base_settings` has (entity, section, key, value), `environment`
    (entity, env_name, value). Resolved settings land below the runtime root. The sync is
    forced by `force` or by FORCE_VARIABLE in `variables`, the job's own environment.
    """
    root = runtime_root.rstrip("/")
    output_root, data_root = f"{root}/output", f"{root}/data"
    release_root, settings_path = f"{output_root}/release", f"{root}/runtime_settings"
    asked = (variables or {}).get(FORCE_VARIABLE, "").strip().lower() in ("1", "true", "yes", "on")
    state = snapshots.sync_release(spark, source, release_root, force or asked)
    layout = manifests.ReleaseLayout(release_root, output_root, repo_root)
    repaired, rejected = repair_tree(spark, release_root, layout)

    base = base_settings.select("entity", "section", "key", F.lit("base").alias("layer"), "value")
    # The overlay is a fixed list of a dozen rows, set for every entity.
    rows = [
        F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit("overlay").alias("layer"), F.lit(v).alias("value"))
        for s, k, v in settings.fixed_overlay(output_root, release_root, data_root)
    ]
    entities = base_settings.select("entity").unionByName(environment.select("entity")).distinct()
    fixed = entities.select("entity", F.inline(F.array(*rows)))
    layers = settings.resolve(base.unionByName(fixed).unionByName(settings.environment_layer(environment)))
    layers = persist_reliably(layers.select("entity", "section", "key", "value"))
    gated = settings.gate_layer(layers, environment)
    resolved = layers.join(gated, ["entity", "section", "key"], "left_anti").unionByName(gated)
    resolved.write.mode("overwrite").parquet(settings_path)
    return spark.createDataFrame(
        [(root, output_root, release_root, data_root, settings_path, state, repaired, rejected.count())],
        "runtime_root string, output_root string, release_root string, data_root string, "
        "runtime_settings string, sync_state string, n_repaired bigint, n_rejected bigint",
    )
