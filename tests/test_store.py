"""Batches, segments, snapshots, the segmented index, and files of any size."""

import hashlib
import json
import resource

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.engine import Engine
from strata.operators import search
from strata.sources import bounded, store as stores, transcripts
from strata.sources.store import Store
from strata.streaming import incremental
from tests import transcripts as t

AT = "2026-07-01T10:00:00Z"


def table(spark, *pairs):
    return spark.createDataFrame(pairs, "session_id string, n int")


def held(store, name="t"):
    return {r.session_id: r.n for r in store.read(name).collect()}


def test_segments_merge_on_read_and_write_what_they_hold(spark, tmp_path):
    store = Store(spark, str(tmp_path), most=3)
    want = {f"s{i}": i for i in range(200)}
    store.replace("t", table(spark, *want.items()), table(spark, *want.items()))
    whole = store.manifest()["tables"]["t"]["segments"][0]
    for k in range(9):
        touched = [f"s{k}", f"s{k + 1}", f"new{k}"]
        want = {s: n for s, n in want.items() if s not in touched} | {f"s{k}": 1000 + k, f"new{k}": k}
        store.replace("t", table(spark, (f"s{k}", 1000 + k), (f"new{k}", k)), table(spark, *[(x, 0) for x in touched]))
        assert held(store) == want
        segments = store.manifest()["tables"]["t"]["segments"]
        assert len(segments) <= 3 and store.version("t") == k + 2
        if k < 2:
            assert segments[0] == whole  # the large segment is not written again
    assert store.vacuum() == 0


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.replace("t", table(spark, ("a", 1)), table(spark, ("a", 1)))
    with store.batch():
        store.replace("t", table(spark, ("a", 2)), table(spark, ("a", 0)))
        store.write("u", table(spark, ("b", 3)))
        store.mark("m", "x")
        assert held(store) == {"a": 2} and held(other) == {"a": 1} and not other.version("u")
    assert held(other) == {"a": 2} and held(other, "u") == {"b": 3} and other.marks() == {"m": "x"}
    with pytest.raises(ZeroDivisionError):
        with store.batch():
            store.write("u", table(spark, ("b", 4)))
            1 / 0
    assert held(other, "u") == {"b": 3} == held(store, "u") and store.vacuum() == 1
    assert held(store, "u") == {"b": 3}


def test_old_manifests_and_their_folders_go(spark, tmp_path):
    store = Store(spark, str(tmp_path), keep=2)
    for i in range(6):
        store.write("t", table(spark, ("a", i)))
    assert held(store) == {"a": 5} and len(list((tmp_path / "data/t").iterdir())) == 2 == len(list((tmp_path / "manifests").glob("m*.json")))


def test_a_snapshot_is_checked_before_it_appears(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.replace("t", table(spark, ("a", 1), ("b", None)), table(spark, ("a", 1)))
    store.replace("t", table(spark, ("a", 2)), table(spark, ("a", 0)))
    told = store.snapshot(str(tmp_path / "copy"))
    assert told["t"]["rows"] == 2 and json.loads((tmp_path / "copy/snapshot.json").read_text())["tables"] == told
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "copy/t")).collect())) == [("a", 2), ("b", None)]
    with pytest.raises(FileExistsError):
        store.snapshot(str(tmp_path / "copy"))
    sums = iter([{"rows": 1}, {"rows": 2}])
    monkeypatch.setattr(stores, "_digest", lambda rows: next(sums))
    with pytest.raises(RuntimeError):
        store.snapshot(str(tmp_path / "bad"))
    assert not list(tmp_path.glob("bad*"))


def said(folder, name, *texts):
    t.write(folder / f"{name}.jsonl", [t.user(name, AT, x) for x in texts])


def test_search_follows_a_sync_and_an_interrupted_index_goes_on(spark, tmp_path, monkeypatch):
    folder = tmp_path / "claude"
    names = ("one", "two", "three", "four", "five", "six", "seven", "eight")
    for name in names:
        said(folder, name, f"about {name} apples")
    engine, folders = Engine(spark, str(tmp_path / "store")), [(str(folder), "claudecode", 0)]
    engine.sync(folders)
    real, calls = search.index_batch, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        real(*args)
    monkeypatch.setattr(search, "index_batch", breaks)
    with pytest.raises(RuntimeError):
        engine.index(batch=2)
    done = {r.session_id for r in engine.store.read("search_states").collect()}
    assert 0 < len(done) < 8 and {r.session_id for r in engine.search("apples").collect()} == done
    monkeypatch.setattr(search, "index_batch", real)
    assert engine.index() == 8 - len(done) and engine.index() == 0
    find = lambda words: {r.session_id for r in engine.search(words).collect()}
    rest = set(names[3:])
    assert find("apples") == set(names)
    sizes = lambda: [s["bytes"] for s in engine.store.manifest()["tables"]["search_postings"]["segments"]]
    before = len(sizes())
    said(folder, "two", "now of pears")
    engine.sync(folders)
    assert find("apples") == {"one", "three"} | rest and find("pears") == {"two"} and find("two apples") == set()
    assert len(sizes()) == before + 1
    # A session whose text is newer than its index is not found by its old words meanwhile.
    said(folder, "one", "plums instead of it")
    incremental.sync(spark, folders, engine.store)
    with engine.store.batch():
        engine.derive()
    assert find("apples") == {"three"} | rest and find("plums") == set()
    engine.index()
    assert find("plums") == {"one"}
    # Sessions that are gone leave the index.
    left = engine.store.read("catalog").filter("session_id <> 'three'")
    engine.store.write("catalog", left)
    engine.index()
    assert find("apples") == rest and engine.store.read("search_postings").filter("session_id = 'three'").count() == 0


def test_thinking_and_wrappers_are_not_found(spark, tmp_path):
    t.write(tmp_path / "c" / "k.jsonl", [
        t.user("k", AT, [{"type": "text", "text": "<system-reminder>harness words</system-reminder> real ask"}]),
        t.assistant("k", AT, "m1", t.usage(1, 0, 0, 1), [{"type": "thinking", "thinking": "secret musing"}, {"type": "text", "text": "shown answer"}])])
    t.write(tmp_path / "x" / "r.jsonl", [*t.epochs(), t.said(AT, "user", "wish for tea"), {"type": "response_item", "timestamp": AT, "payload": {
        "type": "message", "role": "assistant", "content": [{"type": "thinking", "thinking": "hidden thought"}, {"type": "output_text", "text": "brewed tea"}]}}])
    engine = Engine(spark, str(tmp_path / "store"))
    engine.sync([(str(tmp_path / "c"), "claudecode", 0), (str(tmp_path / "x"), "codex", 1)])
    engine.index()
    find = lambda words: {r.session_id for r in engine.search(words).collect()}
    assert find("real ask") == {"k"} == find("shown answer") and find("brewed tea") == {"r"} == find("wish for tea")
    assert not find("harness words") and not find("secret musing") and not find("hidden thought")


def test_a_broken_sync_goes_on_with_its_batch(spark, tmp_path, monkeypatch):
    folder = tmp_path / "claude"
    for name in "abcd":
        said(folder, name, f"about {name}")
    store, folders = Store(spark, str(tmp_path / "store")), [(str(folder), "claudecode", 0)]
    real, seen = incremental.ingest, []

    def breaks(spark, names, *rest, **more):
        seen.append(names)
        real(spark, names, *rest, **more)
        if len(seen) == 2:
            raise RuntimeError("killed after its tables were written")
    monkeypatch.setattr(incremental, "ingest", breaks)
    with pytest.raises(RuntimeError):
        incremental.sync(spark, folders, store, batch=1)
    ids = lambda: {r.session_id for r in store.read("sessions").collect()}
    assert len(ids()) == 1 == store.read("ledger").count() == store.read("file_hashes").count()
    assert incremental.sync(spark, folders, store, batch=2) == 3
    assert ids() == set("abcd") and seen[0][0] not in [x for names in seen[2:] for x in names]
    assert incremental.sync(spark, folders, store) == 0


def test_the_engine_streams(spark, tmp_path):
    folder = tmp_path / "claude"
    said(folder, "a", "first apples")
    engine = Engine(spark, str(tmp_path / "store"))
    run = lambda: engine.stream(str(folder), "claudecode", str(tmp_path / "checkpoint")).awaitTermination(120)
    run()
    engine.index()
    said(folder, "b", "more apples")
    run()
    assert {r.session_id for r in engine.sessions().collect()} == {"a", "b"} == {r.session_id for r in engine.search("apples").collect()}


def test_usage_is_counted_anew_where_claims_move_alone(spark, tmp_path):
    folder = tmp_path / "claude"
    message = lambda s, day: t.assistant(s, f"2026-07-0{day}T10:00:00Z", "m1", t.usage(10, 0, 0, 5))
    t.write(folder / "late.jsonl", [t.user("late", "2026-07-03T10:00:00Z", "resumed it"), message("late", 3)])
    said(folder, "aside", "no claims here")
    store, folders = Store(spark, str(tmp_path / "store")), [(str(folder), "claudecode", 0)]
    incremental.sync(spark, folders, store)
    native = lambda: {r.session_id: r.native_total_output_tokens for r in store.read("native_usage").collect()}
    assert native() == {"late": 5, "aside": 0}
    t.write(folder / "early.jsonl", [t.user("early", "2026-07-01T10:00:00Z", "began it"), message("early", 1)])
    incremental.sync(spark, folders, store)
    assert native() == {"late": 0, "early": 5, "aside": 0}
    touched = spark.read.parquet(f"{store.root}/{store.manifest()['tables']['native_usage']['segments'][-1]['keys']}")
    assert {r.session_id for r in touched.collect()} == {"late", "early"}
    t.write(folder / "early.jsonl", [t.user("early", "2026-07-01T10:00:00Z", "began it and dropped the message")])
    incremental.sync(spark, folders, store)
    assert native() == {"late": 5, "early": 0, "aside": 0}


def test_long_lines_pass_through_a_buffer(spark, tmp_path):
    big = 100 << 20
    with open(tmp_path / "x.jsonl", "wb") as f:
        f.write(b'{"n":1}\n' + b"a" * big + b"\n" + b'{"n":2}\n' + b"b" * 2_000_000)
    (tmp_path / "y.jsonl").write_bytes(b"")
    (tmp_path / "z.jsonl").write_bytes(b'{"n":3}\r\n{"n":4}')
    lines, found = bounded.read_lines(spark, [str(tmp_path)], 1 << 20, 8 << 20)
    assert [r.value for r in lines.orderBy("file", "seq").collect()] == ['{"n":%d}' % n for n in (1, 2, 3, 4)]
    assert sorted((r.start, r.bytes) for r in found.collect()) == [(8, big), (8 + big + 1 + 8, 2_000_000)]
    with bounded.opened(str(tmp_path / "x.jsonl")) as source:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        assert list(bounded.long_in_range(source, 0, 4, 1 << 20)) == [] and list(bounded.long_in_range(source, 4, 16, 1 << 20)) == [(8, big)]
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 20_000  # KB


@pytest.mark.parametrize("part", [1, 3, 7, 100])
def test_ranges_share_lines_out(tmp_path, part):
    data = b"ab\n\ncdefgh\n" + b"i" * 9 + b"\nj\n" + b"k" * 5
    (tmp_path / "f").write_bytes(data)
    want, at = [], 0
    for line in data.split(b"\n"):
        want += [(at, len(line))] if len(line) > 4 else []
        at += len(line) + 1
    got, short = [], []
    for begin in range(0, len(data), part):
        with bounded.opened(str(tmp_path / "f")) as source:
            got += bounded.long_in_range(source, begin, begin + part, 4)
            short += bounded.short_in_range(source, begin, begin + part, 4)
    assert got == want and short == [(0, b"ab"), (3, b""), (21, b"j")]


@pytest.mark.parametrize("buffer", [1, 2, 5])
def test_lines_cross_buffers(tmp_path, monkeypatch, buffer):
    monkeypatch.setattr(bounded, "BUFFER", buffer)
    test_ranges_share_lines_out(tmp_path, 4)


def test_files_are_hashed_whole(spark, tmp_path):
    bodies = {"a.bin": b"", "b.bin": bytes(range(256)) * 40_000}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    listed = spark.createDataFrame([(str(tmp_path / n),) for n in bodies], "file string")
    got = {r.file.rsplit("/", 1)[1]: (r.size, r.sha256) for r in bounded.hashed_files(listed).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
    good = hashlib.sha256(b"x").hexdigest()
    for name, body in ((f"{good}.jsonl", b"x"), ("0" * 64 + ".bin", b"y")):
        (tmp_path / "store/raw/sha256" / name[:2]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "store/raw/sha256" / name[:2] / name).write_bytes(body)
    assert [r.sha256 for r in bounded.verified_objects(spark, str(tmp_path / "store")).collect()] == [good]


def test_places_are_gathered_in_runs_of_documents():
    import pyarrow as pa

    words = [["a", "b", "a"], [], ["b"] * 5, ["c"], ["a", "c", "a", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([["z"], ["z"], *words], pa.list_(pa.string()))], ["doc", "words"]).slice(2)
    told = lambda most: [x.to_pydict() for x in search._placed(("doc",), most)(iter([batch]))]
    rows = lambda found: sorted((d, t, n, tuple(at)) for x in found for t, d, n, at in zip(x["token"], x["doc"], x["n_words"], x["at"]))
    assert len(told(4)) > 2 and max(sum(map(len, x["at"])) for x in told(4)) <= 5
    assert rows(told(4)) == rows(told(1 << 20)) == [(2, "a", 3, (0, 2)), (2, "b", 3, (1,)), (4, "b", 5, (0, 1, 2, 3, 4)), (5, "c", 1, (0,)), (6, "a", 4, (0, 2)), (6, "c", 4, (1, 3))]


def test_small_ranges_read_little_more_than_the_file(tmp_path, monkeypatch):
    """Each range read a whole buffer of a file that it opened anew."""
    path, size = str(tmp_path / "f"), 300_000
    (tmp_path / "f").write_bytes(b"".join(b"%d:%s\n" % (n, b"x" * (n % 60)) for n in range(size // 35))[:size])
    size, told, first = (tmp_path / "f").stat().st_size, {"read": 0, "opened": 0}, bounded.opened

    class Counted:
        def __init__(self, file):
            self.file = file

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            told["read"] += len(data := self.file.read(n))
            return data

    def counted(uri):
        told["opened"] += 1
        return Counted(first(uri))
    monkeypatch.setattr(bounded, "opened", counted)
    rows = [(path, b, b + 1000) for b in range(0, size, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["file", "begin", "end"])
    reader = bounded._in_ranges(bounded.short_in_range, 60, ["start", "value"], [pa.int64(), pa.binary()])
    got = list(reader(iter([batch])))
    lines = (tmp_path / "f").read_bytes().split(b"\n")
    assert [v for b in got for v in b.column("value").to_pylist()] == [x for x in lines if len(x) <= 60 and x]
    assert told["opened"] == 1 and told["read"] < 7 * size and len(got) < 10
