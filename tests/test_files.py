import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from furrow.operators import inventory
from furrow.operators import manifests as ops
from furrow.operators.environment import prepare_environment, repair_tree
from furrow.sources import logs, market, snapshots
from furrow.sources.stores import open_store
from furrow.sources.releases import existing_paths, list_files, registry_present, run_files, scan_manifests


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "源 目录+1"
    for run, document in (("run 1", {"release_dir": "/o/发布/run 1", "a": "/o/x"}), ("run2", {"release_dir": "run2"})):
        (root / run / "模型" / "deep").mkdir(parents=True)
        (root / run / ops.MANIFEST_NAME).write_text(json.dumps(document), encoding="utf-8")
    (root / "run 1" / "模型" / "deep" / "m.bin").write_bytes(b"\x00\xff" * 5000)
    (root / "bare").mkdir()
    (root / "bare" / "x.txt").write_text("x")
    (root / "broken").mkdir()
    (root / "broken" / ops.MANIFEST_NAME).write_bytes(b"\xff\xfe{")
    (root / ops.REGISTRY_NAME).write_text("{}")
    return root


def test_scan_and_listing(spark, tree):
    found = {r.run_id: r for r in scan_manifests(spark, str(tree)).collect()}
    assert set(found) == {"run 1", "run2", "broken"}
    assert json.loads(found["run 1"].document)["a"] == "/o/x"
    assert found["broken"].document is None
    assert found["run 1"].run_dir.endswith("源 目录+1/run 1")
    listing = list_files(spark, str(tree))
    rel = {r.rel_path for r in listing.collect()}
    assert "run 1/模型/deep/m.bin" in rel and ops.REGISTRY_NAME in rel
    assert not [p for p in rel if p.startswith("/")]
    there = {r.rel_path for r in existing_paths(listing).collect()}
    assert {"run 1", "run 1/模型", "run 1/模型/deep", "bare/x.txt"} <= there
    assert "run2/模型" not in there  # an empty directory cannot be seen
    runs = {(r.run_id, r.rel_path) for r in run_files(listing).collect()}
    assert ("run 1", "模型/deep/m.bin") in runs and all(r != ops.REGISTRY_NAME for r, _ in runs)


def test_hidden_and_empty_files_are_part_of_a_tree(spark, tree, tmp_path):
    for name in (".dockerignore", "_run/__init__.py", "run2/.hidden/_x"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("")
    want = {p.relative_to(tree).as_posix() for p in tree.rglob("*") if p.is_file()}
    listing = list_files(spark, f"{tree.parent}//{tree.name}/")
    assert {r.rel_path for r in listing.collect()} == want
    assert snapshots.copy_tree(spark, str(tree), str(tmp_path / "copy")) == len(want)
    assert {p.relative_to(tmp_path / "copy").as_posix() for p in (tmp_path / "copy").rglob("*") if p.is_file()} == want


def test_unknown_stores_are_refused():
    for path in ("/srv/x", "dbfs:/mnt/x", "relative"):
        with pytest.raises(ValueError):
            open_store(path)
    assert open_store("file:/srv/x")[1] == "/srv/x"


def test_missing_root_is_no_error(spark, tmp_path):
    missing = str(tmp_path / "none")
    assert scan_manifests(spark, missing).isEmpty()
    assert list_files(spark, missing).isEmpty()
    assert not registry_present(spark, missing)


def test_sync_states(spark, tree, tmp_path):
    target = tmp_path / "t" / "release"
    assert snapshots.sync_release(spark, str(tree), str(target)) == "replaced"
    assert (target / "run 1" / "模型" / "deep" / "m.bin").read_bytes() == b"\x00\xff" * 5000
    (target / "stale.txt").write_text("s")
    assert snapshots.sync_release(spark, str(tree), str(target)) == "kept"
    assert (target / "stale.txt").exists()
    assert snapshots.sync_release(spark, str(tree), str(target), force=True) == "replaced"
    assert not (target / "stale.txt").exists()
    assert [p.name for p in target.parent.iterdir() if not p.name.startswith(".")] == ["release"]


def test_bad_source_leaves_the_old_release(spark, tree, tmp_path):
    target = tmp_path / "release"
    snapshots.sync_release(spark, str(tree), str(target))
    with pytest.raises(FileNotFoundError):
        snapshots.sync_release(spark, str(tmp_path / "none"), str(target), force=True)
    half = tmp_path / "half"
    (half / "run").mkdir(parents=True)
    (half / "run" / "f").write_text("f")
    with pytest.raises(FileNotFoundError):
        snapshots.sync_release(spark, str(half), str(target), force=True)
    assert (target / ops.REGISTRY_NAME).exists()


def test_repair_in_place(spark, tree):
    layout = ops.ReleaseLayout("/n/release", "/n", "/")
    count, rejected = repair_tree(spark, str(tree), layout)
    assert count == 2 and [r.run_id for r in rejected.collect()] == ["broken"]
    document = json.loads((tree / "run 1" / ops.MANIFEST_NAME).read_text(encoding="utf-8"))
    assert document["a"] == "/n/x" and document["release_dir"] == "/n/release/run 1"
    assert repair_tree(spark, str(tree), layout)[0] == 0


def test_environment_summary(spark, tree, tmp_path):
    base = spark.createDataFrame([("e", "llm", "model", "m0"), ("e", "x", "y", "z")], "entity string, section string, key string, value string")
    env = spark.createDataFrame([("e", "CROP_LLM_MODEL", "m1"), ("e", "CROP_ACTIVE_RELEASE_POLICY", "latest")], "entity string, env_name string, value string")
    root = str(tmp_path / "rt")
    summary = prepare_environment(spark, root, str(tree), base, env, "/srv").first()
    assert (summary.sync_state, summary.n_repaired, summary.n_rejected) == ("replaced", 2, 1)
    values = {(r.section, r.key): r.value for r in spark.read.parquet(summary.runtime_settings).collect()}
    assert values["llm", "model"] == "m1" and values["x", "y"] == "z"
    assert values["serving", "active_release_policy"] == "latest"
    assert values["feedback", "training_sample_csv"] == f"{root}/output/feedback/training_samples.csv"


def test_dataset_sink_replaces_only_its_runs(spark, tmp_path):
    path = str(tmp_path / "ds")
    schema = "run_id string, repaired string"
    snapshots.write_manifest_dataset(spark.createDataFrame([("a", "1"), ("b", "2")], schema), path)
    snapshots.write_manifest_dataset(spark.createDataFrame([("b", "3")], schema), path)
    assert {r.run_id: r.repaired for r in spark.read.schema("repaired string, run_id string").parquet(path).collect()} == {"a": "1", "b": "3"}


def test_csv_keeps_null_and_empty(spark, tmp_path):
    path = str(tmp_path / "csv")
    frame = spark.createDataFrame([(1, None, None), (2, "", 1), (3, 'a,"b"\\N', 0)], "id int, s string, n int")
    logs.write_csv(frame, path)
    assert sorted(logs.read_csv(spark, path, "id int, s string, n int").collect()) == sorted(frame.collect())


def test_market_reads_are_typed(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text("crop_id,region_id,period,price,yield,cost\n1,2,2020-01-01,1.5,2,0.5\n")
    row = market.read_market(spark, str(csv), "csv").first()
    assert (row.crop_id, str(row.period), row.price) == (1, "2020-01-01", 1.5)
    names = tmp_path / "n.csv"
    names.write_text("source_name,crop_id\nRice,7\n")
    assert market.read_mapping(spark, str(names)).first().crop_id == 7
    path = str(tmp_path / "m.parquet")
    market.read_market(spark, str(csv), "csv").write.parquet(path)
    assert market.read_market(spark, path).count() == 1


def test_inventory_of_a_tree(spark, tree):
    (tree / "bare" / "__pycache__").mkdir()
    (tree / "bare" / "__pycache__" / "x.py").write_text("x")
    (tree / "bare" / "y.pyc").write_text("y")
    extras = list_files(spark, str(tree / "bare")).selectExpr("concat('bare/', rel_path) as path")
    tracked = spark.createDataFrame([("README.md",), ("bare/x.txt",)], "path string")
    out = inventory.staging_files(inventory.build_inventory(tracked, extras))
    assert [r.path for r in out.collect()] == ["bare/x.txt"]


def test_task_functions_need_no_installed_package(tmp_path):
    dump = tmp_path / "f.pickle"
    dump.write_bytes(cloudpickle.dumps([snapshots._copy_files, snapshots._write_texts]))
    code = f"from pyspark import cloudpickle; cloudpickle.loads(open({str(dump)!r}, 'rb').read())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={}, check=True)
