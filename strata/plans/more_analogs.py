"""Further operators over the driver's tables: paths, text, child tables, publication states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import classify, text
from strata.operators import archive, filters, narrative, paths, reports, scan, search, sinks, usage, visibility
from strata.plans.analogs import Catalog, continued, query


@query("SELECT CAST(conv_id AS STRING) AS file, row_number() OVER w AS event_index, SUM(strlen(text) + 1) OVER w - strlen(text) - 1 AS byte_start, SUM(strlen(text) + 1) OVER w AS byte_end FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)".replace("SUM(strlen(text) + 1) OVER w - strlen(text) - 1", "(SUM(strlen(text) + 1) OVER w - strlen(text) - 1)::BIGINT").replace("SUM(strlen(text) + 1) OVER w AS", "(SUM(strlen(text) + 1) OVER w)::BIGINT AS"))
def chk_rows(c: Catalog) -> DataFrame:
    lines = c.table("conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("seq"), F.col("text").alias("value"))
    return archive.numbered(lines).select("file", F.col("event_index").cast("long").alias("event_index"), "byte_start", "byte_end")


CANDIDATE = "CASE p_partkey % 8 WHEN 0 THEN CONCAT('\"src/', p_brand, '.py\",') WHEN 1 THEN CONCAT('https://x.y/', p_brand) WHEN 2 THEN CONCAT('-', p_brand) WHEN 3 THEN CONCAT('a/', p_brand, ':12:3') WHEN 4 THEN 'Makefile' WHEN 5 THEN 'plain words' WHEN 6 THEN '..' ELSE CONCAT('file:///tmp/', p_brand) END"


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CONCAT('src/', p_brand, '.py\"') WHEN 3 THEN CONCAT('a/', p_brand) WHEN 4 THEN 'Makefile' ELSE CONCAT('/tmp/', p_brand) END AS path FROM part WHERE p_partkey % 8 IN (0, 3, 4, 7)")
def cls_looks_path(c: Catalog) -> DataFrame:
    rows = c.sql(f"SELECT p_partkey, {CANDIDATE} AS x FROM {{part}}")
    return rows.filter(classify.looks_like_path(F.col("x"))).select("p_partkey", classify.clean_path(F.col("x")).alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CONCAT('/w/app/src/', p_size, '.py') WHEN 1 THEN CONCAT('/etc/d/', p_size) ELSE CONCAT('/w/app/a/', p_size) END AS normalized_path, CASE p_partkey % 3 WHEN 0 THEN CONCAT('src/', p_size, '.py') WHEN 2 THEN CONCAT('a/', p_size) END AS relative_path, CASE p_partkey % 3 WHEN 0 THEN CONCAT('src/', p_size, '.py') WHEN 1 THEN CONCAT('…/d/', p_size) ELSE CONCAT('a/', p_size) END AS display_path FROM part")
def cls_norm_path(c: Catalog) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("src//"), "p_size", F.lit(".py"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/etc/./d/"), "p_size")).otherwise(F.concat(F.lit("/w/app/a/"), "p_size"))
    form = paths.normalized(raw, F.lit("/w/app/"), F.lit("/home/me"))
    return c.table("part").select("p_partkey", form.alias("n")).select("p_partkey", "n.*")


@query("SELECT session_id, spawn_depth > 0 OR (source = 'claudecode' AND (n % 5 = 0 OR n % 7 = 0)) AS subagent FROM sessions")
def cls_subagent(c: Catalog) -> DataFrame:
    parent, path = F.when(F.col("n") % 5 == 0, "p").otherwise(" "), F.when(F.col("n") % 7 == 0, "C:\\x\\subagents\\a").otherwise("/x/y")
    return c.sessions.select("session_id", classify.is_subagent(F.col("spawn_depth"), F.col("source"), parent, path).alias("subagent"))


@query("SELECT doc_id, CASE WHEN length(x) <= 60 THEN x ELSE substr(x, 1, 59) || '…' END AS goal FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents) d")
def cls_narrative_clip(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", classify.clip(F.col("text"), 60).alias("goal"))


# Activity of a session by its number: files written, runs and failures of checks, commits, errors.
TOLD = """SELECT session_id, source, repo_name, project, CONCAT('do ', o_orderpriority) AS first_user_message, n % 4 AS write_path_count, CASE WHEN n % 4 > 1 THEN 'src/a.py, b.md' END AS samples,
  n % 3 AS test_run_count, CASE WHEN n % 6 = 5 THEN 2 ELSE 0 END AS test_failure_count, CASE WHEN n % 8 < 3 THEN n % 8 ELSE 0 END AS lint_run_count, CASE WHEN n % 24 = 2 THEN 1 ELSE 0 END AS lint_failure_count,
  CASE WHEN n % 5 = 0 THEN 2 ELSE 0 END AS build_run_count, CASE WHEN n % 20 = 0 THEN 1 ELSE 0 END AS build_failure_count, CASE WHEN n % 9 = 4 THEN 1 ELSE 0 END AS format_run_count, 0 AS format_failure_count,
  CASE WHEN n % 7 = 0 THEN n % 3 ELSE 0 END AS git_commit_count, CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS error_count FROM {sessions}"""


def _many(count: str, word: str) -> str:
    return f"CONCAT({count}, ' {word}', CASE WHEN {count} <> 1 THEN 's' ELSE '' END)"


def _ran(kind: str, name: str) -> str:
    with_ = f"CASE WHEN {kind}_failure_count > 0 THEN CONCAT(' with ', {_many(kind + '_failure_count', 'failure')}) ELSE '' END"
    return f"CASE WHEN {kind}_run_count > 0 THEN CONCAT('Ran {name} ', {_many(kind + '_run_count', 'time')}, {with_}, '.') END"


BROKEN = "nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {k}_failure_count > 0 THEN {_many(k + '_failure_count', k + ' failure')} END" for k in ("test", "lint", "build")) + "), '')"


@continued(f""", t AS ({TOLD.replace("{sessions}", "sessions")}),
g AS (SELECT *, write_path_count > 0 OR format_run_count > 0 OR git_commit_count > 0 OR test_run_count > test_failure_count OR build_run_count > build_failure_count OR lint_run_count > lint_failure_count AS good,
  error_count + test_failure_count + lint_failure_count + build_failure_count > 0 AS bad, {BROKEN} AS broken FROM t),
r AS (SELECT *, CASE WHEN bad AND good THEN 'partial' WHEN bad THEN 'failed' WHEN good THEN 'success' ELSE 'exploration' END AS session_status FROM g)
SELECT session_id, first_user_message AS session_goal, session_status,
  concat_ws(' ', CONCAT('Worked in ', coalesce(nullif(repo_name, ''), nullif(project, ''), source), '.'),
    CASE WHEN write_path_count > 0 THEN CONCAT('Touched ', {_many("write_path_count", "file")}, CASE WHEN samples IS NULL THEN '' ELSE CONCAT(' (', samples, ')') END, '.') END,
    {_ran("test", "tests")}, {_ran("lint", "lint checks")}, {_ran("build", "builds")},
    CASE WHEN git_commit_count > 0 THEN CONCAT('Made ', {_many("git_commit_count", "git commit")}, '.') WHEN write_path_count + test_run_count + lint_run_count + build_run_count = 0 THEN 'Primarily inspected files and commands.' END) AS session_summary,
  CASE session_status WHEN 'partial' THEN CONCAT('Made progress, but left ', coalesce(broken, 'recorded errors'), '.') WHEN 'failed' THEN CONCAT('Ended with ', coalesce(broken, 'errors'), ' and no successful publish signal.')
    WHEN 'exploration' THEN 'No decisive code-change outcome was recorded.' ELSE CASE WHEN git_commit_count > 0 THEN CONCAT('Ended with ', {_many("git_commit_count", "git commit")}, '.')
    WHEN write_path_count > 0 THEN 'Ended with code changes and no recorded failing checks.' ELSE 'Completed without recorded failures.' END END AS session_outcome FROM r""")
def cls_narrative(c: Catalog) -> DataFrame:
    told = narrative.narrative(c.spark.sql(TOLD, sessions=c.sessions))
    return told.select("session_id", "session_goal", "session_status", "session_summary", "session_outcome")


@query("SELECT session_id FROM sessions WHERE n % 7 = 0 AND n % 3 <> 0 AND n % 2 = 0")
def fts_eligible(c: Catalog) -> DataFrame:
    states = c.sessions.select("session_id", F.when(F.col("n") % 7 == 0, search.VERSION).otherwise(1).alias("index_version"), F.when(F.col("n") % 2 == 0, "ok").otherwise("error").alias("status"), F.when(F.col("n") % 3 == 0, "old").otherwise("h").alias("indexed_hash"))
    return search.eligible(states, c.sessions.withColumn("file_hash", F.lit("h")))


@query("SELECT session_id FROM sessions WHERE n % 7 <> 0 OR n % 3 = 0 OR n % 2 = 1")
def fts_stale(c: Catalog) -> DataFrame:
    states = c.sessions.select("session_id", F.when(F.col("n") % 7 == 0, search.VERSION).otherwise(1).alias("index_version"), F.when(F.col("n") % 2 == 0, "ok").otherwise("error").alias("status"), F.when(F.col("n") % 3 == 0, "old").otherwise("h").alias("indexed_hash"))
    return search.to_index(c.sessions.withColumn("file_hash", F.lit("h")), states).select("session_id")


@query("SELECT session_id, day, total_output_tokens::BIGINT AS total_output_tokens FROM daily WHERE CAST(session_id AS BIGINT) % 5 <> 0 UNION ALL SELECT session_id, '2000-01-01', n FROM sessions WHERE n % 5 = 0 AND n % 10 = 0")
def snk_replace_child(c: Catalog) -> DataFrame:
    touched = c.sessions.filter("n % 5 = 0")
    new = touched.filter("n % 10 = 0").select("session_id", F.lit("2000-01-01").alias("day"), F.col("n").alias("total_output_tokens"))
    return sinks.replace_children(c.daily.select("session_id", "day", "total_output_tokens"), new, touched)


@query("SELECT DISTINCT CAST(l_orderkey AS STRING) AS session_id FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 97 = 0)")
def snk_claims(c: Catalog) -> DataFrame:
    old = c.sql("SELECT CAST(l_partkey AS STRING) AS claim_key, CAST(l_orderkey AS STRING) AS session_id FROM {lineitem}")
    touched = old.filter("cast(session_id as bigint) % 97 = 0").select("session_id").distinct()
    return sinks.affected_claims(old, old.limit(0), touched)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN 'a' || (s_suppkey // 4) || (CASE WHEN s_suppkey % 4 = 1 THEN '-2' ELSE '' END) ELSE 'a' || s_suppkey || 'x' END AS new_name FROM supplier")
def snk_migrate(c: Catalog) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("A"), F.floor(F.col("s_suppkey") / 4))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("a"), F.floor(F.col("s_suppkey") / 4))).otherwise(F.concat(F.lit("a"), "s_suppkey", F.lit("x")))
    return sinks.next_available(c.table("supplier").select("s_suppkey", name.alias("username"))).select("s_suppkey", "new_name")


STATE = {"reviewed_hash": "CASE WHEN n % 3 = 0 THEN 'h' WHEN n % 3 = 1 THEN 'old' END", "reviewed_metadata_hash": "CASE WHEN n % 5 = 0 THEN 'x' ELSE 'm' END", "file_hash": "'h'", "metadata_hash": "'m'", "visibility_source": "CASE WHEN n % 4 = 0 THEN 'manual' ELSE 'rule' END"}
STATED = ", st AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in STATE.items()) + " FROM sessions)"


def _states(c: Catalog) -> DataFrame:
    return c.sessions.withColumns({k: F.expr(v) for k, v in STATE.items()})


@continued(STATED + " SELECT session_id, 'unlisted' AS target FROM st WHERE visibility = 'public' AND (reviewed_hash IS DISTINCT FROM file_hash OR reviewed_metadata_hash IS DISTINCT FROM metadata_hash)")
def pub_drift(c: Catalog) -> DataFrame:
    return visibility.drifted(_states(c))


@continued(STATED + " SELECT session_id FROM st WHERE visibility = 'public' AND reviewed_hash = 'h' AND reviewed_metadata_hash = 'm'")
def pub_public_read(c: Catalog) -> DataFrame:
    return visibility.public_reads(_states(c)).select("session_id")


@continued(STATED + ", g AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'public' ELSE 'private' END AS target FROM st) SELECT session_id, visibility AS from_visibility, target AS to_visibility, CASE WHEN target <> 'public' OR (reviewed_hash = 'h' AND reviewed_metadata_hash = 'm') THEN 'applied' ELSE 'refused' END AS outcome FROM g WHERE target <> visibility")
def vis_transition(c: Catalog) -> DataFrame:
    rows = _states(c)
    wanted = rows.select("session_id", F.when(F.col("n") % 2 == 0, "public").otherwise("private").alias("target"))
    return visibility.transition(rows, wanted, "me", "2026-01-01")[1].select("session_id", "from_visibility", "to_visibility", "outcome")


@continued(STATED + ", g AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'public' ELSE 'private' END AS target FROM st) SELECT session_id, CASE WHEN target <> 'public' OR (reviewed_hash = 'h' AND reviewed_metadata_hash = 'm') THEN target ELSE visibility END AS visibility FROM g")
def vis_apply(c: Catalog) -> DataFrame:
    rows = _states(c)
    wanted = rows.select("session_id", F.when(F.col("n") % 2 == 0, "public").otherwise("private").alias("target"))
    return visibility.transition(rows, wanted, "me", "2026-01-01")[0].select("session_id", "visibility")


@continued(STATED + """, r AS (SELECT *, CASE WHEN n % 6 = 0 THEN 'public' WHEN n % 6 < 3 THEN 'unlisted' ELSE 'private' END AS recommendation, list_position(['private', 'unlisted', 'public'], visibility) AS a FROM st)
SELECT session_id, visibility, recommendation FROM r WHERE list_position(['private', 'unlisted', 'public'], recommendation) < a""")
def pub_queue(c: Catalog) -> DataFrame:
    reviews = c.sessions.select("session_id", F.when(F.col("n") % 6 == 0, "public").when(F.col("n") % 6 < 3, "unlisted").otherwise("private").alias("recommendation"))
    return scan.queue(c.sessions, reviews, "needs_changes").select("session_id", "visibility", "recommendation")


@query("SELECT session_id, visibility, n % 6 IN (4, 5) AS needs_changes FROM sessions WHERE visibility = 'unlisted' AND session_status = 'success' AND username = 'u7' AND n % 5 <> 1")
def flt_queue(c: Catalog) -> DataFrame:
    reviews = c.sessions.select("session_id", F.when(F.col("n") % 6 > 3, "private").otherwise("unlisted").alias("recommendation"))
    rows = c.sessions.withColumn("session_origin", F.when(F.col("n") % 5 == 0, "human_direct").when(F.col("n") % 5 == 1, "pipeline_eval"))
    return scan.queue(rows, reviews, "unlisted", "success", "human_direct", "u7").select("session_id", "visibility", "needs_changes")


@query("SELECT session_id, list_position(['private', 'unlisted', 'public'], visibility) <= CASE WHEN n % 3 = 0 THEN 3 ELSE 2 END AS allowed FROM sessions")
def pub_apply(c: Catalog) -> DataFrame:
    recommended = F.when(F.col("n") % 3 == 0, "public").otherwise("unlisted")
    return c.sessions.select("session_id", scan.may_apply(F.col("visibility"), recommended).alias("allowed"))


@continued(STATED + " SELECT session_id, CASE WHEN visibility_source = 'manual' THEN visibility WHEN username LIKE 'u1%' THEN CASE WHEN reviewed_hash = 'h' THEN 'public' ELSE 'unlisted' END ELSE 'private' END AS next_visibility FROM st")
def vis_recompute(c: Catalog) -> DataFrame:
    rules = [{"id": 1, "priority": 1, "field": "username", "mode": "prefix", "pattern": "U1", "visibility": "public"}]
    return visibility.recompute(_states(c).withColumn("default_visibility", F.lit("private")), rules).select("session_id", "next_visibility")


@query("SELECT session_id FROM sessions WHERE CASE WHEN n % 5 = 0 THEN 'human_direct' WHEN n % 5 = 1 THEN 'pipeline_eval' ELSE 'human_direct' END = 'human_direct'")
def flt_origin(c: Catalog) -> DataFrame:
    rows = c.sessions.withColumn("session_origin", F.when(F.col("n") % 5 == 0, "human_direct").when(F.col("n") % 5 == 1, "pipeline_eval"))
    return rows.filter(filters.origin("human_direct")).select("session_id")


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '-') AS handle FROM customer")
def flt_user_ident(c: Catalog) -> DataFrame:
    return c.table("customer").select("c_custkey", filters.normalized_username(F.concat("c_name", F.lit(" & Co."))).alias("handle"))


@query("SELECT username, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (@' || username || ')' ELSE name END AS label FROM (SELECT 'u' || s_suppkey AS username, CASE WHEN s_suppkey % 3 = 0 THEN 'Ann' WHEN s_suppkey % 3 = 1 THEN 'Bob' || s_suppkey ELSE 'u' || s_suppkey END AS name FROM supplier) x")
def agg_user_labels(c: Catalog) -> DataFrame:
    users = c.table("supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("username"), F.when(F.col("s_suppkey") % 3 == 0, "Ann").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Bob"), "s_suppkey")).otherwise(" ").alias("display_name"))
    return reports.user_labels(users)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 50 + l_partkey % 40 <= 60 THEN l_suppkey % 50 ELSE 0 END AS five_minutes, CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 50 + l_partkey % 40 <= 60 THEN l_partkey % 40 ELSE 0 END AS one_hour, CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 50 + l_partkey % 40 <= 60 THEN 60 - l_suppkey % 50 - l_partkey % 40 ELSE 60 END AS unknown FROM lineitem")
def prs_cache_split(c: Catalog) -> DataFrame:
    split = F.when(F.col("l_partkey") % 3 == 0, F.struct((F.col("l_suppkey") % 50).alias("ephemeral_5m_input_tokens"), (F.col("l_partkey") % 40).alias("ephemeral_1h_input_tokens")))
    counts = [F.lit(60 if k == "cache_creation_input_tokens" else 1).cast("long").alias(k) for k in usage.USAGE]
    record = F.struct(*counts, split.alias("cache_creation"))
    use = F.struct(*counts, split.alias("cache_creation"), F.array(record).alias("iterations"))
    return c.table("lineitem").select("l_orderkey", "l_linenumber", usage.cache_split(use).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
