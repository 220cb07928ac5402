"""Older versions are read again from what is left; other versions do not read transcripts."""

import hashlib

import pytest

from strata import engine as engines
from strata.engine import Engine
from strata.operators import search
from strata.sources import managed, transcripts
from strata.streaming import incremental
from tests import transcripts as t

AT = "2026-07-01T10:00:00Z"


def test_a_vanished_source_is_read_from_its_copy_or_waits(spark, tmp_path, monkeypatch):
    folder, kept = tmp_path / "in", tmp_path / "kept"
    kept.mkdir()
    for name in ("stays", "with copy", "spoilt", "gone"):
        t.write(folder / f"{name}.jsonl", [t.user(name, AT, f"about {name}")])
    engine, folders = Engine(spark, str(tmp_path / "store")), [(str(folder), "claudecode", 0)]
    assert engine.sync(folders) == 4
    paths = {r.file.rsplit("/", 1)[1][:-6]: r.file for r in engine.store.read("ledger").collect()}
    rows = []
    for name in ("with copy", "spoilt"):
        body = (folder / f"{name}.jsonl").read_bytes()
        (kept / f"{name}.x").write_bytes(body.replace(b"about", b"still about"))
        rows.append((paths[name], f"file:{kept}/{name}.x", hashlib.sha256((kept / f"{name}.x").read_bytes()).hexdigest()))
        (kept / f"{name}.x").rename(kept / f"{name}.jsonl")
    rows = [(f, c.removesuffix(".x") + ".jsonl", s) for f, c, s in rows]
    (kept / "spoilt.jsonl").write_bytes(b"{}\n")
    engine.adopt(spark.createDataFrame(rows, managed.COPY))
    for name in ("with copy", "spoilt", "gone"):
        (folder / f"{name}.jsonl").unlink()
    assert engine.sync(folders) == 0 and not engine.store.version("retries")  # nothing is due
    monkeypatch.setattr(incremental, "PARSED", 2)
    assert engine.sync(folders) == 2
    told = {r.session_id: r.first_user_message for r in engine.sessions().collect()}
    assert told == {"stays": "about stays", "with copy": "still about with copy", "spoilt": "about spoilt", "gone": "about gone"}
    waits = lambda: {r.file.rsplit("/", 1)[1][:-6]: (r.reason, r.tries) for r in engine.store.read("retries").collect()}
    assert waits() == {"spoilt": ("hash differs", 1), "gone": ("gone", 1)}
    t.write(folder / "gone.jsonl", [t.user("gone", AT, "back again")])
    assert engine.sync(folders) == 1 and waits() == {"spoilt": ("hash differs", 2)}
    assert {r.first_user_message for r in engine.sessions().collect()} >= {"back again"}


def test_a_newer_story_reads_no_transcript(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    t.write(folder / "a.jsonl", [t.user("a", AT, "about apples")])
    engine, folders = Engine(spark, str(tmp_path / "store")), [(str(folder), "claudecode", 0)]
    engine.sync(folders)
    engine.index()
    before = engine.store.version("catalog"), engine.store.version("sessions")
    reads = lambda *a, **k: pytest.fail("a transcript was read")
    monkeypatch.setattr(incremental, "ingest", reads)
    assert engine.sync(folders) == 0 and engine.store.version("catalog") == before[0]
    monkeypatch.setattr(engines, "STORY", 2)
    engine.sync(folders)
    assert (engine.store.version("catalog"), engine.store.version("sessions")) == (before[0] + 1, before[1])
    monkeypatch.setattr(search, "VERSION", search.VERSION + 1)
    assert engine.search("apples").count() == 0
    engine.sync(folders)
    assert [r.session_id for r in engine.search("apples").collect()] == ["a"]


def test_resolution_by_priority(spark, tmp_path):
    good = tmp_path / "good"
    good.write_bytes(b"x")
    sha = hashlib.sha256(b"x").hexdigest()
    rows = [("a", str(good), sha), ("b", str(good), "0" * 64), ("c", str(tmp_path / "none"), sha), ("e", str(good), None), ("f", str(good), sha)]
    due = spark.createDataFrame([(x,) for x in "abcdef"], "file string")
    readable, failed = managed.resolve(due, spark.createDataFrame([("f",), ("z",)], "file string"), spark.createDataFrame(rows, managed.COPY))
    assert {(r.file, r.path, r.via) for r in readable.collect()} == {("a", str(good), "copy"), ("f", "f", "source")}
    assert {(r.file, r.reason) for r in failed.collect()} == {("b", "hash differs"), ("c", "unreadable"), ("d", "gone"), ("e", "no hash on record")}
    assert transcripts.files(spark, str(tmp_path), "none").count() == 0
