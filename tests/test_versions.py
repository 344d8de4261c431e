import hashlib
import json

import pytest

from furrow.operators.manifests import REGISTRY_NAME
from furrow.sources import snapshots, versions


class Lost(Exception):
    pass


def stop_at(step):
    def hook(name):
        if name == step:
            raise Lost(name)

    return hook


def make(root, turn, files=7):
    for i in range(files):
        place = root / f"run {i}" / "模型"
        place.mkdir(parents=True)
        (place / ".part").write_bytes(f"{turn}-{i}".encode() * (i * 50))
    (root / REGISTRY_NAME).write_text(json.dumps({"turn": turn}))
    return str(root)


def tree_of(path):
    from pathlib import Path

    root = Path(path.removeprefix("file:"))
    return {p.relative_to(root).as_posix(): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def in_force(spark, home):
    """The tree a reader gets; its listing must be whole and true."""
    release = versions.current(spark, home)
    files = tree_of(release.path)
    listed = {r.rel_path: (r.length, r.sha256) for r in versions.contents(spark, home).collect()}
    assert listed == {name: (len(raw), hashlib.sha256(raw).hexdigest()) for name, raw in files.items()}
    assert release.files == len(files) and release.bytes == sum(map(len, files.values()))
    return files


@pytest.mark.parametrize("step", versions.STEPS)
def test_readers_find_one_whole_release_wherever_a_job_stops(spark, tmp_path, step):
    first, second, third = (make(tmp_path / f"s{i}", i, files=7 - i) for i in range(3))
    home = str(tmp_path / "home")
    assert versions.current(spark, home) is None and versions.contents(spark, home).isEmpty() and versions.recover(spark, home) == []
    versions.publish(spark, first, home)
    with pytest.raises(Lost):
        versions.publish(spark, second, home, keep=1, on_step=stop_at(step))
    old, new = tree_of(first), tree_of(second)
    assert in_force(spark, home) == (old if step in ("copied", "listed", "sealed") else new)
    versions.recover(spark, home)
    assert in_force(spark, home) == (old if step in ("copied", "listed") else new)
    assert versions.recover(spark, home) == []
    versions.publish(spark, third, home, keep=1)
    assert in_force(spark, home) == tree_of(third)
    assert [len([p for p in (tmp_path / "home" / d).iterdir() if not p.name.startswith(".")]) for d in ("versions", "listings", "sealed", "commits")] == [1, 1, 1, 1]


def test_a_torn_commit_counts_as_not_made(spark, tmp_path):
    source, home = make(tmp_path / "s", 0), str(tmp_path / "home")
    release = versions.publish(spark, source, home)
    (tmp_path / "home" / "commits" / "0000000002").write_text('{"content": {"version": "0000000002-x"')
    assert versions.current(spark, home) == release
    assert versions.recover(spark, home) == ["removed torn commit 0000000002"]
    assert versions.publish(spark, source, home).number == 2


def test_bad_sources_and_a_lost_race_leave_the_release_in_force(spark, tmp_path):
    source, home = make(tmp_path / "s", 0), str(tmp_path / "home")
    release = versions.publish(spark, source, home)
    (tmp_path / "empty").mkdir()
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "x").write_text("x")
    for bad in ("none", "empty", "bare"):
        with pytest.raises(FileNotFoundError):
            versions.publish(spark, str(tmp_path / bad), home)

    def overtaken(step):
        if step == "sealed":
            versions.recover(spark, home)

    with pytest.raises(FileExistsError):
        versions.publish(spark, source, home, on_step=overtaken)
    assert versions.current(spark, home).number == 2 and in_force(spark, home) == tree_of(source)
    assert release.number == 1 and versions.recover(spark, home) == []
    with pytest.raises(ValueError):
        versions.publish(spark, source, home, keep=0)


@pytest.mark.parametrize("step", ["copied", "sealed", "aside", "exchanged"])
def test_the_next_sync_mends_one_that_stopped(spark, tmp_path, step, monkeypatch):
    first, second, target = make(tmp_path / "a", 0), make(tmp_path / "b", 1), tmp_path / "t" / "release"
    snapshots.sync_release(spark, first, str(target))
    if step == "aside":
        def broken(store, incoming, place, outgoing):
            assert store.rename(place, outgoing)
            raise Lost(step)

        monkeypatch.setattr(snapshots, "_exchange", broken)
    with pytest.raises(Lost):
        snapshots.sync_release(spark, second, str(target), force=True, on_step=stop_at(step))
    monkeypatch.undo()
    done = snapshots.recover_sync(spark, str(target))
    assert done == {"copied": ["undone"], "sealed": ["finished"], "aside": ["finished"], "exchanged": []}[step]
    assert tree_of(str(target)) == tree_of(first if step == "copied" else second)
    assert [p.name for p in target.parent.iterdir() if not p.name.startswith(".")] == ["release"]
    assert snapshots.sync_release(spark, second, str(target)) == "kept"


def test_a_tree_set_aside_without_a_seal_comes_back(spark, tmp_path):
    source = make(tmp_path / "t.outgoing-1", 0)
    before = tree_of(source)
    assert snapshots.recover_sync(spark, str(tmp_path / "t")) == ["restored"] and tree_of(str(tmp_path / "t")) == before
