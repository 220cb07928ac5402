"""A record is gone through once for what is asked of it."""

from pyspark.sql import functions as F

from strata.operators import records, render, usage
from strata.plans import analogs, parsed, shown  # noqa: F401  (they register their queries)
from strata.sources import transcripts

LINES = [("/c/r.jsonl", 1, '{"type":"session_meta","payload":{"id":"t"}}'), ("/c/r.jsonl", 2, '{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"a"},{"type":"output_text","text":" "},{"type":"output_text","text":"b"}]}}'),
         ("/c/r.jsonl", 3, '{"type":"response_item","payload":{"type":"message","role":"user","content":"ask me"}}'), ("/c/r.jsonl", 4, '{"type":"response_item","payload":{"type":"reasoning","summary":[{"text":" "}]}}')]


def test_codex_makes_what_is_wanted_alone(spark):
    rows = transcripts.records(spark.createDataFrame(LINES, "file string, seq int, value string"))
    tables = records.codex(rows, ("ids",))
    assert list(tables) == ["ids"] and [(r.session_id, r.thread_id) for r in tables["ids"].collect()] == [("r", "t")]


def test_display_of_codex_parses_a_line_once(spark):
    """Each kind of turn parsed all lines anew."""
    shown = render.codex(transcripts.records(spark.createDataFrame(LINES, "file string, seq int, value string")))
    assert [(r.seq, r.place, r.kind, r.text) for r in shown.orderBy("seq", "place").collect()] == [(2, 0, "text", "a"), (2, 2, "text", "b"), (3, 0, "user", "ask me")]
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("Project [file") > 0 and shown._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan()


def test_head_of_a_session_is_one_aggregation(spark):
    """A count of prompts was joined to the ids, of fields that were written for all of a session."""
    plan = _plan(analogs.QUERIES["prs_claude_ident"](spark, "/root/testdata/sf0.001"))
    assert plan.toString().count("Aggregate [") == 1 and "Join" not in plan.toString() and plan.collectLeaves().apply(0).toString().count("event_id") == 1


def test_heads_of_claudecode(spark):
    """Counts, title and model of a head are those of the session: meta prompts count but give no title, blank ones and tool results neither."""
    user = '{"type":"user","sessionId":"s","message":{"role":"user","content":%s}%s}'
    said = [user % ('" "', ""), user % ('"meta"', ',"isMeta":true'), user % ('[{"type":"text","text":" do "},{"type":"text","text":"it"}]', ""), user % ('"more"', ""),
            user % ('[{"type":"tool_result","tool_use_id":"c","is_error":true},{"type":"tool_result","tool_use_id":"d"},{"type":"text","text":"hook"}]', ""), user % ('{"type":"tool_result","tool_use_id":"c","is_error":true}', ""),
            '{"type":"assistant","message":{"id":"m","model":"","content":[{"type":"tool_use","name":"A","id":"c"},{"type":"tool_use","name":"B","id":"d"}],"usage":{"output_tokens":3}}}', '{"type":"assistant","message":{"id":"m","model":"m-1","content":"x","usage":{"output_tokens":5}}}', " "]
    rows = transcripts.records(spark.createDataFrame([("/p/a.jsonl", i, v) for i, v in enumerate(said)] + [("/p/b.jsonl", 0, '{"type":"summary"}')], "file string, seq int, value string"))
    names = ["session_id", "user_message_count", "tool_call_count", "error_count", "first_user_message", "model"]
    heads = records.claude(rows, ("heads",))["heads"].select(*names).orderBy("session_id").collect()
    assert [tuple(r) for r in heads] == [("a", 3, 2, 2, "do  it", "m-1"), ("b", 0, None, None, None, None)]
    sessions = records.claude(rows, ("sessions",))["sessions"].select(*names, "assistant_message_count", "total_output_tokens").orderBy("session_id").collect()
    assert [tuple(r) for r in sessions] == [("a", 3, 2, 2, "do  it", "m-1", 1, 5), ("b", 0, 0, 0, "", None, 0, 0)]


def test_a_line_is_made_once(spark):
    """A line made of other columns was made to be filtered and again to be parsed."""
    made = spark.range(3).select(F.lit("f").alias("file"), F.col("id").alias("seq"), F.to_json(F.struct(F.lit("user").alias("type"), F.col("id").alias("n"))).alias("value"))
    rows = transcripts.records(made)
    assert _plan(rows).toString().count("StructsToJsonEvaluator") == 1 and rows.count() == 3


def _moves(plan):
    return plan.toString().count("Exchange hashpartitioning")


def test_calls_turns_and_sessions_move_lines_once(spark):
    """Lines were made of written items, their fields were written, and calls met their results, their files and their sessions in joins."""
    for name in ("prs_claude_tools", "prs_user_msgs", "prs_claude", "prs_render"):
        query = analogs.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert "Join" not in query.optimizedPlan().toString() and query.optimizedPlan().collectLeaves().size() == 2, name
        assert _moves(query.executedPlan()) == 1, name


def test_scalars_of_a_session_have_its_model(spark):
    """The model is one of a session's scalars, and was left out."""
    row = analogs.QUERIES["prs_session_scalars"](spark, "/root/testdata/sf0.001").filter("model is not null").first()
    assert row is not None and len(row.model) == 2


def test_results_meet_the_call_before_them(spark):
    """The last result before the next call of the same id counts; one before any call, or without an id, counts nowhere."""
    rows = [("f", "a", 1, False, True), ("f", "a", 2, True, None), ("f", "a", 3, False, True), ("f", "a", 4, False, False), ("f", "a", 5, True, None), ("f", "a", 6, True, None), ("f", "a", 7, False, True), ("f", None, 8, True, None), ("f", None, 9, False, True)]
    found = usage.with_results(spark.createDataFrame(rows, "file string, call_id string, seq int, _call boolean, _error boolean"))
    assert [(r.seq, r.is_error) for r in found.orderBy("seq").collect()] == [(2, False), (5, False), (6, True), (8, False)]


def test_reject_reads_names_of_an_object(spark):
    """The check read the whole line's text by a pattern; names that a record lacks are not looked up, and those written with escapes count."""
    lines = ['{"type":"user","message":{"content":[1,"x"]}}', r'{"type":3}', '{"type":"user","message":{"content":true}}', '{"type":"user","message":{"usage":{"cache_creation":{"ephemeral_5m_input_tokens":"x"}}}}', '{"type":"user","message":{"usage":{"input_tokens":null}}}', '{"payload":{"source":{"subagent":{"thread_spawn":{"depth":[]}}}}}', '{"type":"event_msg","payload":{"type":"token_count"}}', '{"type":"event_msg","payload":{"type":"token_count","info":[]}}', '{"message":null,"cwd":null,"id":1.5}']
    v = spark.createDataFrame(list(enumerate(lines)), "n int, value string").select("n", F.try_parse_json("value").alias("v"))
    told = [r.why for r in v.select("n", transcripts.reject_reason().alias("why")).orderBy("n").collect()]
    assert told == [None, "type", "message.content", "message.usage.cache_creation.ephemeral_5m_input_tokens", None, "payload.source.subagent.thread_spawn.depth", None, "payload.info", "id"]
    assert "RLIKE" not in _plan(transcripts.records(spark.createDataFrame(LINES, "file string, seq int, value string"))).toString()


CLAIMED = [("/p/a.jsonl", 0, '{"type":"user","sessionId":"s","message":{"content":"x"}}'), ("/p/a.jsonl", 1, '{"type":"assistant","requestId":"r","message":{"id":"m","usage":{"output_tokens":3}}}'),
           ("/p/a.jsonl", 2, '{"type":"user","timestamp":"2026-02-02T01:00:00Z","message":{"content":"x"}}'), ("/p/a.jsonl", 3, '{"type":"assistant","requestId":"r","timestamp":"2026-02-03T01:00:00Z","message":{"id":"m","usage":{"output_tokens":3}}}'),
           ("/p/a.jsonl", 4, '{"type":"assistant","uuid":"u","timestamp":"bad","message":{"id":"n"}}'), ("/p/a.jsonl", 5, '{"type":"assistant","message":{"id":"o","usage":{"output_tokens":1}}}'), ("/p/a.jsonl", 6, '{"type":"assistant","message":{"id":""}}'),
           ("/p/b.jsonl", 1, '{"type":"assistant","agentId":"z","message":{"id":"m","usage":{"output_tokens":1}}}'), ("/p/b.jsonl", 0, '{"type":"user","agentId":"y","timestamp":"","message":{"content":"x"}}'), ("/p/b.jsonl", 2, '{"type":"assistant","message":{"id":"m","usage":{"output_tokens":2}}}'),
           ("/p/c.jsonl", 0, '{"type":"user","isSidechain":true,"message":{"content":"x"}}'), ("/p/c.jsonl", 1, '{"type":"assistant","message":{"id":"m"}}'), ("/p/c.jsonl", 1, '{"type":"assistant","message":{"id":"m"}}'),
           (None, 0, '{"type":"assistant","message":{"id":"m","usage":{"output_tokens":9}}}'), ("/p/d.jsonl", 0, '{"type":"user","message":{"content":"x"}}')]


def test_claims_alone_are_those_among_other_tables(spark):
    """Copies, odd days, agents that differ, empty ids, a file without messages, a line that comes twice, and lines of no file."""
    rows = transcripts.records(spark.createDataFrame(CLAIMED, "file string, seq int, value string"))
    shown = lambda wanted: sorted(tuple(r) for r in records.claude(rows, wanted)["claims"].select("claim_key", "session_id", F.coalesce("day", F.lit("")), "total_output_tokens").collect())
    alone = shown(("claims",))
    assert alone == [("m:r", "a", "2026-02-02", 3), ("mid:m", "agent-c", "", 0), ("mid:m", "agent-y", "", 2), ("mid:o", "a", "2026-02-02", 1), ("uuid:u", "a", "2026-02-02", 0)]
    assert alone == shown(("claims", "messages"))
    split = transcripts.records(spark.createDataFrame(CLAIMED, "file string, seq int, value string").withColumn("seq", F.struct(F.lit(0).alias("block"), "seq")))
    assert alone == sorted(tuple(r) for r in records.claude(split, ("claims",))["claims"].select("claim_key", "session_id", F.coalesce("day", F.lit("")), "total_output_tokens").collect())


def test_claims_sort_no_part_of_the_written_fields(spark):
    """A task sorted all rows of its part of the written fields, to find a file's session and to leave out copies."""
    plan = analogs.QUERIES["prs_claim_key"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(plan) if "FileScan" in line or "Scan parquet" in line]
    assert len(scans) == 2
    for at in scans:
        # Up from the scan to the first move of rows.
        below = plan[max(i for i in range(at) if "Exchange" in plan[i]):at]
        assert not [line for line in below if "Sort" in line or "WindowGroupLimit" in line], below
