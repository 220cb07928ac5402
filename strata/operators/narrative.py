"""Per-session activity counts, status, and the sentences that tell them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.classify import CHECKS, clip, runs_check, session_status, zero

OPERATIONS = ("write", "read", "search")
GIT = ("status", "diff", "commit")


def activity(sessions: DataFrame, calls: DataFrame, paths: DataFrame) -> DataFrame:
    """session_id and its counts: distinct paths by operation, runs and failures of checks, git commands.

    A command may count in several families.
    """
    command = F.lower(F.trim(F.coalesce("command", F.lit(""))))
    runs = []
    for kind in CHECKS:
        hit = runs_check(F.col("command"), kind)
        runs += [F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias(f"{kind}_run_count"), F.sum(F.when(hit & F.col("is_error"), 1).otherwise(0)).cast("long").alias(f"{kind}_failure_count")]
    runs += [F.sum(F.when(F.regexp_like(command, F.lit(rf"\bgit\s+{g}\b")), 1).otherwise(0)).cast("long").alias(f"git_{g}_count") for g in GIT]
    by_call = calls.groupBy("session_id").agg(*runs)
    by_path = paths.filter(F.col("operation").isin(*OPERATIONS)).groupBy("session_id").agg(*[F.countDistinct(F.when(F.col("operation") == o, F.col("normalized_path"))).alias(f"{o}_path_count") for o in OPERATIONS])
    out = sessions.select("session_id").join(by_call, "session_id", "left").join(by_path, "session_id", "left")
    return out.select("session_id", *[zero(F.col(c)).alias(c) for c in out.columns if c != "session_id"])


def status(errors: Column) -> Column:
    """Status of a row with the counts of `activity`."""
    changed = (F.col("write_path_count") > 0) | (F.col("format_run_count") > 0) | (F.col("git_commit_count") > 0)
    passed = (F.col("test_run_count") > F.col("test_failure_count")) | (F.col("build_run_count") > F.col("build_failure_count")) | (F.col("lint_run_count") > F.col("lint_failure_count"))
    failed = zero(errors) > 0
    for kind in CHECKS:
        failed = failed | (F.col(f"{kind}_failure_count") > 0)
    return session_status(changed, passed, failed)


def sampled_paths(paths: DataFrame, most: int = 2) -> DataFrame:
    """session_id, samples: the first distinct written paths, in the shortest form that is known."""
    forms = [F.nullif(F.col(c), F.lit("")) for c in ("repo_relative_path", "relative_path", "display_path") if c in paths.columns]
    first = paths.filter("operation = 'write'").select("session_id", "seq", F.coalesce(*forms).alias("label")).filter("label is not null").groupBy("session_id", "label").agg(F.min("seq").alias("seq"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))).filter(F.col("n") <= most)
    return ranked.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]), ", ").alias("samples"))


def _plural(count: Column, word: str) -> Column:
    return F.concat(count, F.lit(f" {word}"), F.when(count != 1, "s").otherwise(""))


def narrative(rows: DataFrame) -> DataFrame:
    """Adds session_goal, session_summary, session_outcome, session_status to rows of sessions with their
    activity and `samples`."""
    rows = rows.withColumn("session_status", status(F.col("error_count")))
    writes, commits = F.col("write_path_count"), F.col("git_commit_count")
    scope = F.coalesce(F.nullif(F.col("repo_name"), F.lit("")), F.when(F.col("project") != "unknown", F.nullif(F.col("project"), F.lit(""))), F.col("source"))
    listed = F.when(F.coalesce("samples", F.lit("")) != "", F.concat(F.lit(" ("), "samples", F.lit(")"))).otherwise("")
    bits = [F.concat(F.lit("Worked in "), scope, F.lit(".")), F.when(writes > 0, F.concat(F.lit("Touched "), _plural(writes, "file"), listed, F.lit(".")))]
    for kind, name in (("test", "tests"), ("lint", "lint checks"), ("build", "builds")):
        runs, failures = F.col(f"{kind}_run_count"), F.col(f"{kind}_failure_count")
        bits.append(F.when(runs > 0, F.concat(F.lit(f"Ran {name} "), _plural(runs, "time"), F.when(failures > 0, F.concat(F.lit(" with "), _plural(failures, "failure"))).otherwise(""), F.lit("."))))
    ran = (F.col("test_run_count") > 0) | (F.col("lint_run_count") > 0) | (F.col("build_run_count") > 0)
    bits.append(F.when(commits > 0, F.concat(F.lit("Made "), _plural(commits, "git commit"), F.lit("."))).when((writes == 0) & ~ran, "Primarily inspected files and commands."))
    broken = F.concat_ws(", ", *[F.when(F.col(f"{k}_failure_count") > 0, _plural(F.col(f"{k}_failure_count"), f"{k} failure")) for k in ("test", "lint", "build")])
    left = lambda other: F.when(broken != "", broken).otherwise(other)
    outcome = (
        F.when(F.col("session_status") == "success", F.when(commits > 0, F.concat(F.lit("Ended with "), _plural(commits, "git commit"), F.lit("."))).when(writes > 0, "Ended with code changes and no recorded failing checks.").otherwise("Completed without recorded failures."))
        .when(F.col("session_status") == "partial", F.concat(F.lit("Made progress, but left "), left("recorded errors"), F.lit(".")))
        .when(F.col("session_status") == "failed", F.concat(F.lit("Ended with "), left("errors"), F.lit(" and no successful publish signal.")))
        .otherwise("No decisive code-change outcome was recorded."))
    return rows.withColumns({"session_goal": clip(F.col("first_user_message"), 180), "session_summary": F.concat_ws(" ", *bits), "session_outcome": outcome})


def with_repositories(sessions: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Sessions with repository columns of a table of workspaces (workspace_root, repo_root, repo_name,
    worktree_root, branch, commit, dirty); executors run no git."""
    return sessions.drop("repo_root", "repo_name", "worktree_root", "branch", "commit", "dirty").join(workspaces, "workspace_root", "left")
