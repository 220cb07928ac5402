"""Named predicates of the list queries, as Columns or semi-joins."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.classify import ORIGINS, objective_family, objective_seed, zero

_some = lambda name: zero(F.col(name)) > 0

#: Activity filters by name.
ACTIVITY = {
    "writes": lambda: _some("write_path_count"),
    "reads": lambda: _some("read_path_count"),
    "searches": lambda: _some("search_path_count"),
    "tests": lambda: _some("test_run_count"),
    "test_failures": lambda: _some("test_failure_count"),
    "lint": lambda: _some("lint_run_count"),
    "lint_failures": lambda: _some("lint_failure_count"),
    "build": lambda: _some("build_run_count"),
    "build_failures": lambda: _some("build_failure_count"),
    "format": lambda: _some("format_run_count"),
    "format_failures": lambda: _some("format_failure_count"),
    "git_status": lambda: _some("git_status_count"),
    "git_diff": lambda: _some("git_diff_count"),
    "git_commit": lambda: _some("git_commit_count"),
    "errors": lambda: _some("error_count"),
}


def activity(name: str) -> Column:
    if name not in ACTIVITY:
        raise ValueError(f"unknown activity: {name}")
    return ACTIVITY[name]()


def origin(name: str, column: str = "session_origin") -> Column:
    """`all` passes every row; a missing origin is a person's own session."""
    if name == "all":
        return F.lit(True)
    if name not in ORIGINS:
        raise ValueError(f"unknown origin: {name}")
    return F.coalesce(F.col(column), F.lit("human_direct")) == name


def equal_or_empty(column: str, value: str) -> Column:
    """Equality in which null and the empty string are one value."""
    return F.coalesce(F.col(column), F.lit("")) == value


def null_as_empty(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def matches_text(value: str, *columns: str) -> Column:
    """Case-insensitive part; % and _ in the value are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{value}%"), F.lit(False))
    return out


def since_until(since: str | None, until: str | None, column: str = "first_timestamp") -> Column:
    """Bounds on ISO text; a bare date as `until` includes that day."""
    out = F.lit(True)
    if since:
        out = out & (F.col(column) >= since)
    if until:
        out = out & (F.col(column) < until + "T99" if len(until) == 10 else F.col(column) <= until)
    return out


def days(since: str | None, until: str | None, column: str = "day") -> Column:
    """Whole days, both ends included; rows without a day never pass."""
    out = F.col(column).isNotNull() & (F.col(column) != "")
    if since:
        out = out & (F.col(column) >= since[:10])
    if until:
        out = out & (F.col(column) <= until[:10])
    return out


def with_path(sessions: DataFrame, paths: DataFrame, value: str) -> DataFrame:
    """Sessions that touched a path like `value`."""
    hit = paths.filter(matches_text(value, *[c for c in ("normalized_path", "relative_path", "repo_relative_path", "display_path") if c in paths.columns]))
    return sessions.join(hit.select("session_id"), "session_id", "left_semi")


def with_objective(sessions: DataFrame, text: str) -> DataFrame:
    """Sessions of one objective family; families not stored are derived."""
    stored = F.nullif(F.col("objective_family"), F.lit(""))
    derived = objective_family(objective_seed(F.col("session_goal"), F.col("first_user_message"), F.col("session_summary")))
    return sessions.filter(F.coalesce(stored, derived, F.lit("")) == F.coalesce(objective_family(F.lit(text)), F.lit("")))


def by_prefix(rows: DataFrame, prefix: str, column: str = "session_id") -> DataFrame:
    """The row of this id, or the one row whose id begins with it; several such rows raise."""
    found = rows.filter(F.col(column).startswith(prefix)).orderBy((F.col(column) == prefix).desc(), column).limit(2)
    ids = [r[0] for r in found.select(column).collect()]
    if len(ids) == 2 and ids[0] != prefix:
        raise ValueError(f"ambiguous prefix: {prefix}")
    return rows.filter(F.col(column) == ids[0]) if ids else rows.limit(0)


def normalized_username(name: Column) -> Column:
    """Lower case, other than letters and digits as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def by_username(users: DataFrame, name: str) -> DataFrame:
    """The user of this exact name, else of the same normalised name."""
    same = users.filter((F.col("username") == name) | (F.col("username") == normalized_username(F.lit(name))))
    return same.orderBy((F.col("username") == name).desc()).limit(1)


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a file-name pattern fits the whole path or the last part; # begins a comment."""
    base, out = F.regexp_extract(path, r"([^/]*)$", 1), F.lit(False)
    for line in patterns:
        pattern = line.strip()
        if pattern and not pattern.startswith("#"):
            regex = "^" + fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "") + r"\z"
            out = out | F.regexp_like(path, F.lit(regex)) | F.regexp_like(base, F.lit(regex))
    return out
