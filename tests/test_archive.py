"""A line of the archive is walked once, and only where it is asked for."""

from strata.operators import archive


def test_a_shown_session_alone_is_walked(spark):
    """All lines went through Python, and each was parsed for its session, its fragments and its raw text."""
    body = '{"sessionId":"s%d","type":"user","message":{"role":"user","content":[{"type":"text","text":"said %d"}]}}'
    rows = [("f", 1, "claudecode", body % (1, 1)), ("f", 2, "claudecode", body % (2, 2)), ("f", 3, "claudecode", "  "), ("f", 4, "claudecode", "no record"), ("f", 5, "claudecode", '{"type":"user","content":"on"}'), ("g", 1, "codex", '{"type":"event_msg","payload":{"type":"x","message":"did"}}')]
    lines = spark.createDataFrame(rows, "file string, seq int, dialect string, value string")
    found = archive.show(archive.chunks(lines), "s2")
    assert [(r.event_index, r.kind, r.role, r.text) for r in found.collect()] == [(2, "message", "user", "said 2"), (4, "raw", None, "no record"), (5, "message", "user", "on")]
    told = archive.chunks(lines).orderBy("file", "event_index").select("event_index", "session_id", "byte_start", "text").collect()
    assert [tuple(r) for r in told] == [(1, "s1", 0, "said 1"), (2, "s2", 1 + len(rows[0][3]), "said 2"), (4, "s2", 5 + 2 * len(rows[0][3]), "no record"), (5, "s2", 15 + 2 * len(rows[0][3]), "on"), (1, None, 0, "did")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    evaluated = [k for k, line in enumerate(plan) if "ArrowEvalPython" in line]
    picked = [k for k, line in enumerate(plan) if "Filter" in line and "= s2" in line]
    assert evaluated and picked and max(evaluated) < min(picked)
    assert sum(line.count("parse_json(value") for line in archive.chunks(lines)._jdf.queryExecution().optimizedPlan().toString().splitlines()) <= 2
