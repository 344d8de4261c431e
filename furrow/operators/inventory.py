"""File inventories: union, filters, component order, mirror and upsert plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import paths
from furrow.functions.text import render_template

# What an inventory never takes from its extra paths, and the file it replaces.
CACHE_DIR = "__pycache__"
COMPILED_SUFFIX = ".pyc"
ROOT_README = "README.md"
TEMPLATE_KEY = "__ARTIFACT_REPO_ID__"


def is_source_file(path: Column) -> Column:
    """False for compiled files and anything below a cache directory."""
    return ~F.array_contains(F.split(path, "/"), CACHE_DIR) & ~path.endswith(COMPILED_SUFFIX)


def build_inventory(tracked: DataFrame, extras: DataFrame) -> DataFrame:
    """Distinct `path` of both listings; only the extras are filtered."""
    listed = tracked.select("path").filter(F.col("path") != "")
    more = extras.select("path").filter((F.col("path") != "") & is_source_file(F.col("path")))
    return listed.union(more).distinct()


def staging_files(inventory: DataFrame) -> DataFrame:
    """The inventory without the README at its root, which a template replaces."""
    return inventory.filter(F.col("path") != ROOT_README)


def sort_by_component(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy(paths.components(F.col("path")))


def render(df: DataFrame, template: str, replacements: dict[str, Column], out: str = "rendered") -> DataFrame:
    """Fill the placeholders of every row's template, in the given order."""
    pairs = F.array(
        *[F.struct(F.lit(key).alias("key"), value.alias("value")) for key, value in replacements.items()]
    )
    return df.withColumn(out, render_template(F.col(template), pairs))


def publish_record(owner: Column, artifacts_name: Column, space_name: Column, host: str) -> Column:
    """Repository ids and addresses of one publication."""
    artifacts = F.concat_ws("/", owner, artifacts_name)
    space = F.concat_ws("/", owner, space_name)
    return F.struct(
        owner.alias("owner"),
        artifacts.alias("artifacts_repo_id"),
        space.alias("space_repo_id"),
        F.concat_ws("/", F.lit(host), F.lit("datasets"), artifacts).alias("artifacts_url"),
        F.concat_ws("/", F.lit(host), F.lit("spaces"), space).alias("space_url"),
    )


def mirror_plan(source: DataFrame, target: DataFrame, delete_extra: bool = True) -> DataFrame:
    """Action per path: upload, update, keep and, for a mirror, delete.

    Both listings have (path, content_hash), one row per path.
    """
    s = source.select("path", F.col("content_hash").alias("source_hash"))
    t = target.select("path", F.col("content_hash").alias("target_hash"))
    joined = s.join(t, "path", "full_outer" if delete_extra else "left")
    action = (
        F.when(F.col("source_hash").isNull(), "delete")
        .when(F.col("target_hash").isNull(), "upload")
        .when(F.col("source_hash") != F.col("target_hash"), "update")
        .otherwise("keep")
    )
    return joined.select("path", action.alias("action"))


def upsert_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """What has to be sent when nothing may be deleted: new and changed paths."""
    return mirror_plan(source, target, delete_extra=False).filter(F.col("action") != "keep")
