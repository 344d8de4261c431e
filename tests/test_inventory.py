from furrow.operators import inventory
from pyspark.sql import functions as F


def listing(spark, pairs):
    return spark.createDataFrame(pairs, "path string, content_hash string")


def paths_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "path string")


def test_filter_applies_to_extras_only(spark):
    tracked = paths_of(spark, ["a/__pycache__/t.py", "t.pyc", "README.md", "", "a"])
    extras = paths_of(spark, ["b/__pycache__/x", "b/x.pyc", "b/x__pycache__y", "a", "docs/README.md", ""])
    out = inventory.build_inventory(tracked, extras)
    got = [r.path for r in inventory.sort_by_component(out).collect()]
    assert got == ["README.md", "a", "a/__pycache__/t.py", "b/x__pycache__y", "docs/README.md", "t.pyc"]
    assert "README.md" not in [r.path for r in inventory.staging_files(out).collect()]


def test_plans(spark):
    source = listing(spark, [("a", "1"), ("b", "2"), ("c", "3")])
    target = listing(spark, [("b", "2"), ("c", "x"), ("d", "4")])
    mirror = {r.path: r.action for r in inventory.mirror_plan(source, target).collect()}
    assert mirror == {"a": "upload", "b": "keep", "c": "update", "d": "delete"}
    upsert = {r.path: r.action for r in inventory.upsert_plan(source, target).collect()}
    assert upsert == {"a": "upload", "c": "update"}


def test_record_and_render(spark):
    record = inventory.publish_record(F.lit("me"), F.lit("data"), F.lit("app"), "https://h")
    row = spark.range(1).select(record.alias("r")).first().r
    assert row.artifacts_url == "https://h/datasets/me/data" and row.space_repo_id == "me/app"
    frame = spark.createDataFrame([("x __ARTIFACT_REPO_ID__ y __ARTIFACT_REPO_ID__", "me/data")], "t string, repo string")
    out = inventory.render(frame, "t", {inventory.TEMPLATE_KEY: F.col("repo")})
    assert out.first().rendered == "x me/data y me/data"
