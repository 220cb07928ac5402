"""Transcripts of both dialects to session tables."""

import pytest
from pyspark.sql import functions as F

from strata.operators import catalog, records, usage
from strata.operators.paths import session_paths
from strata.sources import transcripts as source
from strata.streaming.incremental import derive
from tests import transcripts as t


def load(spark, path):
    return source.records(source.read_lines(spark, str(path)))


def one(tables):
    rows = tables["sessions"].collect()
    assert len(rows) == 1
    return rows[0]


def test_forked_snapshot(spark, tmp_path):
    t.write(tmp_path / "rollout-branch.jsonl", t.forked())
    tables = records.codex(load(spark, tmp_path))
    s = one(tables)
    assert (s.fresh_input_tokens, s.cached_input_tokens, s.total_input_tokens, s.total_output_tokens, s.reasoning_output_tokens) == (1300, 1100, 2400, 270, 45)
    assert (s.user_message_count, s.tool_call_count, s.error_count) == (1, 1, 1)
    assert (s.session_id, s.thread_id, s.parent_thread_id, s.spawn_depth) == ("rollout-branch", "branch", "trunk", 2)
    assert s.first_user_message == "Plan the index" and s.project == "/w/branch"
    call = tables["tool_calls"].collect()[0]
    assert call.command == "cat src/index.py && pytest" and call.operation == "read" and call.is_error and call.command_paths == ["src/index.py"]


def test_copy_without_own_task_is_all_inherited(spark, tmp_path):
    t.write(tmp_path / "x.jsonl", t.forked()[:6])
    s = one(records.codex(load(spark, tmp_path)))
    assert (s.total_input_tokens, s.user_message_count, s.tool_call_count) == (0, 0, 0)


def test_second_meta_must_match(spark, tmp_path):
    rows = t.forked()
    rows[1]["payload"]["id"] = "other"
    t.write(tmp_path / "x.jsonl", rows)
    s = one(records.codex(load(spark, tmp_path)))
    assert s.total_input_tokens == 9_400 and s.user_message_count == 2


def test_counter_epochs(spark, tmp_path):
    t.write(tmp_path / "x.jsonl", t.epochs())
    s = one(records.codex(load(spark, tmp_path)))
    assert (s.fresh_input_tokens, s.cached_input_tokens, s.total_input_tokens, s.total_output_tokens, s.reasoning_output_tokens) == (450, 750, 1200, 130, 40)


def test_wobble_and_rate_limits_are_no_reset(spark, tmp_path):
    at = "2026-05-02T10:00:00Z"
    rows = [t.meta(at, id="a"), t.tokens(at, 500, 100, 50, 5), t.tokens(at, 480, 90, 50, 5), {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {}}}, t.tokens(at, 600, 150, 70, 9)]
    t.write(tmp_path / "x.jsonl", rows)
    s = one(records.codex(load(spark, tmp_path)))
    assert (s.total_input_tokens, s.cached_input_tokens, s.total_output_tokens) == (600, 150, 70)


def test_claude_messages_are_counted_once(spark, tmp_path):
    block = {"type": "tool_use", "id": "c1", "name": "Edit", "input": {"file_path": "/w/app/src/a.py:12", "old_string": "x"}}
    shell = {"type": "tool_use", "id": "c2", "name": "Bash", "input": {"command": "pytest tests/test_a.py -q"}}
    rows = [
        t.user("s1", "2026-07-01T10:00:00Z", "<system-reminder>x</system-reminder>", isMeta=True),
        t.user("s1", "2026-07-01T10:00:01Z", [{"type": "text", "text": "Fix the bug"}]),
        t.assistant("s1", "2026-07-01T10:00:02Z", "m1", t.usage(10, 0, 5, 7), [block]),
        t.assistant("s1", "2026-07-01T23:30:00-05:00", "m1", t.usage(10, 0, 5, 20), [shell]),
        t.assistant("s1", "2026-07-01T10:00:04Z", "m1", t.usage(99, 0, 99, 20), []),
        t.user("s1", "2026-07-01T10:00:05Z", [{"type": "tool_result", "tool_use_id": "c2", "content": "no", "is_error": True}]),
        "not json", "[1, 2]", "", t.user("s1", "2026-07-01T10:00:06Z", "bye") | {"cwd": 7},
    ]
    t.write(tmp_path / "-home-me-app" / "s1.jsonl", rows)
    lines = source.read_lines(spark, str(tmp_path))
    tables = records.claude(source.records(lines))
    s = one(tables)
    assert (s.fresh_input_tokens, s.cached_input_tokens, s.total_input_tokens, s.total_output_tokens) == (10, 5, 15, 20)
    assert (s.user_message_count, s.assistant_message_count, s.tool_call_count, s.error_count) == (2, 1, 2, 1)
    assert s.first_user_message == "Fix the bug" and s.model == "m-1" and s.thread_id == "s1" and s.spawn_depth == 0
    assert {r.reject: r.lines for r in source.reject_counts(lines).collect()} == {"invalid_json": 1, "not_object": 1, "cwd": 1}
    calls = {c.call_id: c for c in tables["tool_calls"].collect()}
    assert calls["c1"].operation == "write" and calls["c1"].input_paths == ["/w/app/src/a.py"] and not calls["c1"].is_error and calls["c2"].is_error
    paths = {(p.normalized_path, p.relative_path, p.operation, p.source) for p in session_paths(tables["tool_calls"]).collect()}
    assert paths == {("/w/app/src/a.py", "src/a.py", "write", "tool_input"), ("/w/app/tests/test_a.py", "tests/test_a.py", "command", "command")}
    days = {d.day: d for d in records.daily(tables).collect()}
    assert days["2026-07-02"].total_output_tokens == 20 and days["2026-07-01"].tool_call_count == 1 and days["2026-07-02"].tool_call_count == 1
    assert usage.violations(records.daily(tables), tables["sessions"], records.MEASURES).count() == 0


@pytest.mark.parametrize("use,want", [
    (t.usage(1, 600, 2, 3, cache_creation={"ephemeral_5m_input_tokens": 400, "ephemeral_1h_input_tokens": 200},
             iterations=[t.usage(1, 600, 2, 3, cache_creation={"ephemeral_5m_input_tokens": 1, "ephemeral_1h_input_tokens": 2}), t.usage(1, 600, 2, 3, cache_creation={"ephemeral_5m_input_tokens": 100, "ephemeral_1h_input_tokens": 500}), t.usage(1, 5, 2, 3)]), (100, 500, 0)),
    (t.usage(1, 600, 2, 3, cache_creation={"ephemeral_5m_input_tokens": 500, "ephemeral_1h_input_tokens": 500}), (0, 0, 600)),
    (t.usage(1, 600, 2, 3), (0, 0, 600)),
    (t.usage(1, 600, 2, 3, cache_creation={"ephemeral_5m_input_tokens": -1, "ephemeral_1h_input_tokens": 10}), (0, 0, 600)),
])
def test_cache_split(spark, tmp_path, use, want):
    t.write(tmp_path / "s.jsonl", [t.assistant("s", "2026-07-01T10:00:00Z", "m", use)])
    s = one(records.claude(load(spark, tmp_path)))
    assert (s.cache_creation_5m_input_tokens, s.cache_creation_1h_input_tokens, s.cache_creation_unknown_input_tokens) == want
    assert s.cache_creation_input_tokens == 600 and s.total_input_tokens == 603


def test_usage_without_a_day_goes_to_the_first(spark, tmp_path):
    t.write(tmp_path / "s.jsonl", [t.user("s", "2026-07-03T10:00:00Z", "hello there"), t.assistant("s", None, "m", t.usage(40, 20, 0, 40))])
    tables = records.claude(load(spark, tmp_path))
    days = records.daily(tables).collect()
    assert [(d.day, d.approximated, d.total_input_tokens, d.total_output_tokens, d.cache_creation_unknown_input_tokens) for d in days] == [("2026-07-03", 1, 60, 40, 20)]


def test_subagent_identity(spark, tmp_path):
    t.write(tmp_path / "-tmp-demo" / "root-session" / "subagents" / "agent-worker.jsonl", [t.user("root-session", "2026-07-01T10:00:00Z", "work", isSidechain=True)])
    s = one(records.claude(load(spark, tmp_path)))
    assert (s.session_id, s.thread_id, s.parent_thread_id, s.spawn_depth) == ("agent-worker", "worker", "root-session", 1)


def test_owner_does_not_depend_on_order(spark, tmp_path):
    shared = t.assistant("x", "2026-07-01T10:00:00Z", "m1", t.usage(10, 0, 0, 5))
    for name in ("claim-parent", "claim-child"):
        t.write(tmp_path / f"{name}.jsonl", [t.user(name, "2026-07-01T10:00:00Z", "hello there"), shared])
    tables = records.claude(load(spark, tmp_path))
    assert tables["claims"].count() == 2
    for order in ("session_id", "file"):
        owners = catalog.claim_owners(tables["claims"].orderBy(F.desc("session_id")), tables["sessions"].orderBy(order)).collect()
        assert [(o.claim_key, o.session_id) for o in owners] == [("m1:req-m1", "claim-child")]
    native = catalog.native_usage(tables["claims"], tables["sessions"].withColumn("uses_claims", F.lit(True)), ("total_output_tokens",))
    assert sorted((r.session_id, r.native_total_output_tokens) for r in native.collect()) == [("claim-child", 5), ("claim-parent", 0)]


def test_lines_keep_their_order_when_files_are_split(spark, tmp_path):
    t.write(tmp_path / "big.jsonl", [{"type": "x", "n": i, "pad": "y" * 200} for i in range(4000)])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        lines = source.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = [r.n for r in lines.select(F.get_json_object("value", "$.n").cast("int").alias("n"), "seq").orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == list(range(4000))


def test_derive_gives_all_tables(spark, tmp_path):
    t.write(tmp_path / "a.jsonl", t.forked())
    tables = derive(load(spark, tmp_path), "codex")
    assert tables["session_paths"].count() == 1 and tables["session_daily_usage"].count() == 1 and tables["turns"].count() == 2


def test_infer_dialect_and_stems(spark, tmp_path):
    t.write(tmp_path / "a" / "one.jsonl", t.forked())
    t.write(tmp_path / "b" / "two.jsonl", [t.user("s", "2026-07-01T10:00:00Z", "x")])
    t.write(tmp_path / "c" / "three.jsonl", [{"hello": 1}])
    got = {r.file.rsplit("/", 1)[1]: r.dialect for r in source.infer_dialect(source.read_lines(spark, str(tmp_path))).collect()}
    assert got == {"one.jsonl": "codex", "two.jsonl": "claudecode", "three.jsonl": "jsonl"}
    files = spark.createDataFrame([("/x/s.jsonl", 1), ("/y/s.jsonl", 0), ("/y/subagents/workflows/w/journal.jsonl", 0), ("/y/skip-me.jsonl", 0)], "file string, priority int")
    kept = source.first_stem(source.transcripts_only(files, ["skip-*", "# note"])).collect()
    assert [r.file for r in kept] == ["/y/s.jsonl"]
    names = spark.createDataFrame([("/p/-home-me-my-app/s.jsonl",), ("/p/-home-x/root/subagents/agent-1.jsonl",)], "p string")
    assert [r[0] for r in names.select(source.project_of_path(F.col("p"))).collect()] == ["app", "home"]


def test_reject_reasons(spark):
    cases = [
        ('{"type":3}', "type"), ('{"type":"user","message":"x"}', "message"), ('{"message":{"usage":{"input_tokens":"abc"}}}', "message.usage.input_tokens"), ('{"message":{"usage":{"input_tokens":"12","output_tokens":null}}}', None),
        ('{"payload":{"type":"token_count","info":null}}', "payload.info"), ('{"payload":{"type":"token_count"}}', None), ('{"payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":[1]}}}}', "payload.info.total_token_usage.input_tokens"),
        ('{"payload":{"type":"other","info":3}}', None), ('{"type":"response_item","payload":{"type":"function_call","name":3}}', "payload.name"), ('{"type":"function_call","name":null}', "name"), ('{"type":"x","name":3}', None),
        ('{"payload":{"source":{"subagent":{"thread_spawn":{"depth":"x"}}}}}', "payload.source.subagent.thread_spawn.depth"), ('{"payload":null}', "payload"), ('{"payload":{"source":"cli"}}', None),
        ('{"message":{"content":5,"id":{}},"timestamp":1}', "timestamp"), ('{"message":{"content":5,"id":{}}}', "message.id"), ("[1]", "not_object"), ("{", "invalid_json"), ('{"cwd":null,"id":true}', None)]
    rows = spark.createDataFrame([("f", i, v) for i, (v, _) in enumerate(cases)], "file string, seq int, value string")
    got = {r.seq: r.reject for r in source.parsed_lines(rows).collect()}
    assert [(v, got[i]) for i, (v, _) in enumerate(cases)] == cases


def test_one_table_writes_what_it_is_made_of_alone(spark, tmp_path, monkeypatch):
    t.write(tmp_path / "s.jsonl", [t.user("s", "2026-07-03T10:00:00Z", "hello there"), t.assistant("s", "2026-07-03T10:00:01Z", "m", t.usage(40, 20, 0, 40))])
    rows, written = load(spark, tmp_path), []
    monkeypatch.setattr(records, "staged", lambda df, label: written.append((label, set(df.columns))) or df)
    claims = records.claude(rows, ("claims",))["claims"]
    assert [label for label, _ in written] == ["fields"] and not {"texts", "calls", "results"} & written[0][1]
    assert [(c.session_id, c.day, c.total_output_tokens) for c in claims.collect()] == [("s", "2026-07-03", 40)]


def test_lines_that_look_good_are_good(spark):
    """Reasons are the same whether or not a line's text was enough to pass it."""
    from pyspark.sql import functions as F

    texts = ['{"type":"user","message":{"content":"x"}}', '{"ty\\u0070e":5}', '{"type" : 5}', '{"type":"user","message":"x"}', '{"type":"a","message":{"usage":{"input_tokens":"7"}}}', '{"type":"a","message":{"usage":{"input_tokens":"x"}}}',
             '{"type":"a","id":1.5}', '{"type":"a","id":3}', '{"type":"a","cwd":null}', '{"type":"function_call","name":3}', '{"type":"b","input":{"name":3}}', '{"a":"\\"type\\": 5"}', '{"type":"x","payload":{"type":"token_count","info":null}}', ' {"type":null}']
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(texts)], "file string, seq int, value string")
    got = {r.seq: r.reject for r in source.parsed_lines(lines).collect()}
    want = {r.seq: r.why for r in lines.select("seq", F.try_parse_json("value").alias("v")).select("seq", source.reject_reason().alias("why")).collect()}
    assert got == want and sum(x is not None for x in want.values()) >= 7
