"""Pushes: what is planned, what a push leaves, and what a failed one does not."""

import hashlib
import json

import pytest

from strata.sources import push


@pytest.fixture
def files(spark, tmp_path):
    bodies = {"a.jsonl": b"one\n", "b.txt": b"two" * 700_000, "copy of a.jsonl": b"one\n", "d.strange": b""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    rows = [(f"file:{tmp_path}/{n}", hashlib.sha256(b).hexdigest()) for n, b in bodies.items()]
    return spark.createDataFrame(rows, "file string, sha256 string"), bodies


def names(rows):
    return sorted(r.file.rsplit("/", 1)[1] for r in rows.collect())


def test_a_push_writes_objects_and_one_manifest(spark, tmp_path, files):
    rows, bodies = files
    root = str(tmp_path / "store")
    assert names(push.push(spark, rows, root, dry_run=True)) == ["a.jsonl", "b.txt", "d.strange"] and not (tmp_path / "store").exists()
    assert names(push.push(spark, rows, root, limit=2)) == ["a.jsonl", "b.txt"]
    assert names(push.push(spark, rows, root)) == ["d.strange"]
    assert names(push.push(spark, rows, root)) == [] and names(push.push(spark, rows, root, missing_only=False, dry_run=True)) == ["a.jsonl", "b.txt", "d.strange"]
    held = {r.object: (r.sha256, r.bytes) for r in push.held_objects(spark, root).collect()}
    assert len(held) == 3 and {s.rsplit(".", 1)[1] for s in held} == {"jsonl", "txt", "bin"}
    for name, (sha, size) in held.items():
        body = (tmp_path / "store" / name).read_bytes()
        assert (hashlib.sha256(body).hexdigest(), len(body)) == (sha, size) and body in bodies.values()
    told = [json.loads(p.read_text()) for p in (tmp_path / "store/manifest").glob("*.json")]
    assert sorted(t["objects"] for t in told) == [1, 2] and sum(t["bytes"] for t in told) == 4 + 2_100_000


def test_a_failed_push_is_not_held(spark, tmp_path, files):
    rows, _ = files
    root = str(tmp_path / "store")
    (tmp_path / "b.txt").write_bytes(b"changed meanwhile")
    with pytest.raises(Exception, match="has changed"):
        push.push(spark, rows, root)
    assert not list((tmp_path / "store/manifest").glob("*.json"))
    if (tmp_path / "store/manifest/parts").exists():
        assert push.held_objects(spark, root).count() == 0
    assert not [p for p in (tmp_path / "store").rglob("raw/**/*") if p.is_file() and len(p.name.split(".")[0]) != 64]
    (tmp_path / "b.txt").write_bytes(b"two" * 700_000)
    assert len(names(push.push(spark, rows, root))) == 3 and push.held_objects(spark, root).count() == 3
