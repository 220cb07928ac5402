"""From transcripts to reports and search through the engine."""

import json

import pytest
from pyspark.sql import functions as F

from strata.engine import Engine
from strata.operators import narrative
from tests import transcripts as t


@pytest.fixture
def engine(spark, tmp_path):
    edit = {"type": "tool_use", "id": "c1", "name": "Edit", "input": {"file_path": "/w/app/src/a.py"}}
    test = {"type": "tool_use", "id": "c2", "name": "Bash", "input": {"command": "pytest -q"}}
    commit = {"type": "tool_use", "id": "c3", "name": "Bash", "input": {"command": "git commit -m 'x' src/a.py"}}
    at = "2026-07-01T10:00:0{}Z"
    t.write(tmp_path / "claude" / "s1.jsonl", [
        t.user("s1", at.format(0), "Fix the login flow in `auth`"), t.assistant("s1", at.format(1), "m1", t.usage(10, 0, 5, 70), [edit, test, {"type": "text", "text": "I changed the login flow."}]),
        t.user("s1", at.format(2), [{"type": "tool_result", "tool_use_id": "c2", "is_error": True, "content": "1 failed"}]), t.assistant("s1", at.format(3), "m2", t.usage(1, 0, 0, 30), [commit])])
    t.write(tmp_path / "claude" / "root" / "subagents" / "agent-w.jsonl", [t.user("s1", at.format(5), "look around", isSidechain=True)])
    t.write(tmp_path / "codex" / "r1.jsonl", [*t.epochs(), t.said("2026-05-02T10:00:00Z", "user", "Explain billing, mail me@example.com")])
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.sync([(str(tmp_path / "claude"), "claudecode", 0), (str(tmp_path / "codex"), "codex", 1)]) == 3
    return engine


def test_sessions_tell_their_story(engine):
    s = {r.session_id: r for r in engine.sessions().collect()}
    one = s["s1"]
    assert one.session_status == "partial" and one.session_goal == "Fix the login flow in `auth`" and one.objective_family == "fix the login flow in <code>"
    assert one.session_summary == "Worked in /w/app. Touched 1 file (src/a.py). Ran tests 1 time with 1 failure. Made 1 git commit."
    assert one.session_outcome == "Made progress, but left 1 test failure." and one.duration_seconds == 3.0
    assert s["agent-w"].subagent and s["agent-w"].session_origin == "human_delegated" and s["agent-w"].parent_session_id == "s1"
    assert s["r1"].session_status == "exploration" and s["r1"].duration_seconds is None


def test_reports_search_and_review(engine):
    stats = engine.stats("2026-08-01")
    assert engine.stats_text("2026-08-01")[0] == "=== Overview ==="
    over = stats["overview"].first()
    assert (over.total_sessions, over.total_output_tokens) == (3, 230)
    assert {r.pattern: r.session_count for r in stats["by_pattern"].collect()}["subagent"] == 1
    assert [r.month for r in stats["by_period"].collect()] == ["2026-05", "2026-07"]
    assert [(r.tool_name, r.calls) for r in engine.top_tools().collect()] == [("Bash", 2), ("Edit", 1)]
    engine.index()
    assert [r.session_id for r in engine.search("login flow").collect()] == ["s1"]
    assert [r.role for r in engine.show("s").collect()] == ["user", "assistant"]
    found, levels = engine.review()
    assert dict(levels.collect()) == {"s1": "public", "agent-w": "public", "r1": "unlisted"}
    assert engine.context("2026-07-05", source="claudecode", least_children=1, least_tokens=1).count() == 1
    assert {r.next_visibility for r in engine.recompute_visibility([]).collect()} == {"unlisted"}


def test_private_ignored_and_journal_files_stay_out(spark, tmp_path):
    at, folder = "2026-07-01T10:00:00Z", tmp_path / "claude"
    line = lambda s, text: t.user(s, at, text)
    t.write(folder / "open.jsonl", [line("open", "about login flow")])
    t.write(folder / "turned.jsonl", [line("turned", "the login flow again")])
    t.write(folder / "secret.jsonl", [line("secret", "login flow"), line("secret", "[[keep-out]]")])
    t.write(folder / "skip-me.jsonl", [line("skip-me", "login flow")])
    t.write(folder / "root" / "subagents" / "workflows" / "wf" / "journal.jsonl", [line("journal", "login flow")])
    engine, folders = Engine(spark, str(tmp_path / "store")), [(str(folder), "claudecode", 0)]
    assert engine.sync(folders, ignore=("skip-*",), markers=("[[keep-out]]",)) == 3
    engine.index()
    assert {r.session_id for r in engine.sessions().collect()} == {"open", "turned"} == {r.session_id for r in engine.search("login flow").collect()}
    t.write(folder / "turned.jsonl", [line("turned", "the login flow again"), line("turned", "now [[keep-out]]")])
    assert engine.sync(folders, ignore=("skip-*",), markers=("[[keep-out]]",)) == 1
    assert {r.session_id: r.visibility for r in engine.sessions().collect()} == {"open": "unlisted", "turned": "private"}
    assert {r.session_id for r in engine.search("login flow").collect()} == {"open"} and engine.show("turned").count() == 0


def test_decisions_outlive_a_sync(spark, tmp_path):
    at, folder = "2026-07-01T10:00:00Z", tmp_path / "claude"
    for name in ("held", "shown", "plain"):
        t.write(folder / f"{name}.jsonl", [t.user(name, at, f"about {name}")])
    engine, folders = Engine(spark, str(tmp_path / "store")), [(str(folder), "claudecode", 0)]
    assert engine.sync(folders) == 3
    wanted = lambda *pairs: spark.createDataFrame(pairs, "session_id string, target string")
    assert {(r.session_id, r.outcome) for r in engine.set_visibility(wanted(("held", "private"), ("shown", "public")), "me", at).collect()} == {("held", "applied"), ("shown", "refused")}
    engine.mark_reviewed(wanted(("shown", "")))
    assert [r.outcome for r in engine.set_visibility(wanted(("shown", "public")), "me", at).collect()] == ["applied"]
    number = engine.add_rule("project", "contains", "app", "private", priority=2)
    assert engine.add_rule("first_user_message", "equals", "about plain", "unlisted", priority=1) == number + 1 and engine.delete_rule(number + 1) and not engine.delete_rule(99)
    levels = lambda: {r.session_id: (r.visibility, r.visibility_source) for r in engine.sessions().collect()}
    engine.apply_rules()
    assert levels() == {"held": ("private", "manual"), "shown": ("public", "manual"), "plain": ("private", "rule")}
    t.write(folder / "held.jsonl", [t.user("held", at, "about held"), t.user("held", at, "and more")])
    t.write(folder / "shown.jsonl", [t.user("shown", at, "about shown"), t.user("shown", at, "and more")])
    assert engine.sync(folders) == 2
    assert levels() == {"held": ("private", "manual"), "shown": ("unlisted", "source_drift"), "plain": ("private", "rule")}
    assert {r.session_id: r.user_message_count for r in engine.sessions().collect()} == {"held": 2, "shown": 2, "plain": 1}


def test_stream_and_sync_share_a_ledger(spark, tmp_path):
    from strata.sources.store import Store
    from strata.streaming import incremental
    at, folder = "2026-07-01T10:00:00Z", tmp_path / "claude"
    t.write(folder / "a.jsonl", [t.user("a", at, "first")])
    store = Store(spark, str(tmp_path / "store"))
    incremental.stream(spark, str(folder), "claudecode", store, str(tmp_path / "checkpoint")).awaitTermination()
    assert [r.session_id for r in store.read("sessions").collect()] == ["a"]
    assert incremental.sync(spark, [(str(folder), "claudecode", 0)], store) == 0
    t.write(tmp_path / "other" / "a.jsonl", [t.user("a", at, "a later root's copy")])
    assert incremental.sync(spark, [(str(folder), "claudecode", 0), (str(tmp_path / "other"), "claudecode", 1)], store) == 0


def test_status_truth_table(spark):
    zero = dict.fromkeys([f"{k}_{x}_count" for k in ("test", "lint", "build", "format") for x in ("run", "failure")] + ["write_path_count", "git_commit_count"], 0)
    cases = [({}, 0, "exploration"), ({"write_path_count": 1}, 0, "success"), ({"test_run_count": 2, "test_failure_count": 1}, 0, "partial"), ({"test_run_count": 1, "test_failure_count": 1}, 0, "failed"), ({}, 3, "failed"), ({"format_run_count": 1, "format_failure_count": 1}, 0, "partial"), ({"lint_run_count": 1}, 0, "success")]
    rows = [json.dumps(zero | c | {"e": e, "want": want}) for c, e, want in cases]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ", ".join(f"{k} long" for k in zero) + ", e long, want string").alias("r")).select("r.*")
    assert all(r.got == r.want for r in df.withColumn("got", narrative.status(F.col("e"))).collect())
