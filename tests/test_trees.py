import random

import pytest

from furrow.operators import trees


def listing(spark, files):
    return spark.createDataFrame(list(files.items()) or [], "rel_path string, sha256 string")


def random_tree(rng, n):
    names = ["a", "b", "ü", "c d"]
    files = {}
    while len(files) < n:
        path = "/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + f"/f{rng.randint(0, 3)}"
        files[path] = rng.choice("xyz")
    return files


def plan(spark, source, target):
    found, opened = trees.compare_trees(trees.tree_nodes(listing(spark, source)), trees.tree_nodes(listing(spark, target)))
    flat = {(r.path, r.action) for r in trees.flat_plan(listing(spark, source), listing(spark, target)).collect()}
    rows = [(r.path, r.action) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == flat
    want = {(p, "upload") for p in source.keys() - target.keys()} | {(p, "delete") for p in target.keys() - source.keys()}
    assert flat == want | {(p, "update") for p in source.keys() & target.keys() if source[p] != target[p]}
    return opened


def test_plan_equals_the_flat_comparison(spark):
    rng = random.Random(3)
    source = random_tree(rng, 40)
    target = dict(source)
    for path in rng.sample(sorted(target), 6):
        del target[path]
    target |= {"new/deep/er/f": "x", "f": "y", next(iter(target)): "changed"}
    assert plan(spark, source, target) > 1
    assert plan(spark, {}, {}) == 0 and plan(spark, source, source) == 0
    plan(spark, source, {})
    plan(spark, {}, {"x": "1"})


def test_equal_subtrees_are_not_opened(spark):
    source = {f"run{i}/part{j}/file": "same" for i in range(12) for j in range(3)}
    target = source | {"run7/part1/file": "other"}
    # The root, the run and the part.
    assert plan(spark, source, target) == 3


def test_a_folder_in_the_place_of_a_file(spark):
    plan(spark, {"a": "1", "b/c": "2", "b/d": "3"}, {"a/x": "1", "a/y/z": "1", "b": "2"})


def test_digests_tell_names_and_places_apart(spark):
    digests = {}
    for name, files in {"one": {"a/x": "1", "b/y": "2"}, "swapped": {"a/x": "2", "b/y": "1"}, "renamed": {"a/y": "1", "b/x": "2"}, "moved": {"a/x": "1", "a/y": "2"}}.items():
        digests[name] = trees.tree_nodes(listing(spark, files)).filter("path = ''").first().digest
    assert len(set(digests.values())) == 4
    assert trees.tree_nodes(listing(spark, {})).count() == 0
    nodes = {r.path: r for r in trees.tree_nodes(listing(spark, {"a/b/c": "1"})).collect()}
    assert set(nodes) == {"", "a", "a/b", "a/b/c"} and nodes[""].parent is None and nodes["a/b"].parent == "a" and not nodes["a/b/c"].folder


@pytest.mark.parametrize("slices", [1, 7])
def test_a_digest_does_not_depend_on_partitions(spark, slices):
    files = {f"hot/f{i}": str(i) for i in range(300)}
    got = trees.tree_nodes(listing(spark, files).repartition(slices)).filter("path = ''").first().digest
    assert got == trees.tree_nodes(listing(spark, files).coalesce(1)).filter("path = ''").first().digest
