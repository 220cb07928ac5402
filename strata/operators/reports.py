"""Usage reports over the catalog, each a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.classify import PATTERNS, command_category, session_pattern, share, zero
from strata.operators.filters import days, since_until

SUMS = ("total_input_tokens", "total_output_tokens", "cached_input_tokens", "cache_creation_input_tokens")


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def overview(sessions: DataFrame, daily: DataFrame | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row of totals: over whole sessions, or with bounds over day rows."""
    if since is None and until is None:
        rows, first, count = sessions, "first_timestamp", F.count(F.lit(1))
    else:
        rows = daily.filter(days(since, until)).join(sessions.select("session_id", "repo_name"), "session_id")
        first, count = "day", F.countDistinct("session_id")
    return rows.agg(count.alias("total_sessions"), F.min(first).alias("first_date"), F.max(first).alias("last_date"), *map(_total, SUMS), F.countDistinct("repo_name").alias("repos_touched"))


def by_pattern(sessions: DataFrame, daily: DataFrame | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """All classes in their order, with zero rows; `subagent` tells subagent evidence.

    With bounds only tokens of the days in range count, while classes stay those of whole sessions.
    """
    rows = sessions.select("session_id", session_pattern(F.col("spawn_depth"), F.col("user_message_count"), F.col("tool_call_count"), F.col("subagent")).alias("pattern"), "total_output_tokens")
    if since is not None or until is not None:
        used = daily.filter(days(since, until)).groupBy("session_id").agg(F.sum("total_output_tokens").alias("total_output_tokens"))
        rows = rows.drop("total_output_tokens").join(used, "session_id")
    sums = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("total_output_tokens").alias("out"))
    order = sessions.sparkSession.createDataFrame(list(enumerate(PATTERNS)), "pattern_order int, pattern string")
    out = order.join(sums, "pattern", "left").select("pattern_order", "pattern", zero(F.col("n")).alias("session_count"), zero(F.col("out")).alias("total_output_tokens"))
    whole = out.agg(F.sum("total_output_tokens").alias("whole"))
    average = F.when(F.col("session_count") > 0, F.expr("total_output_tokens div session_count")).otherwise(F.lit(0))
    return out.join(F.broadcast(whole)).select("pattern_order", "pattern", "session_count", "total_output_tokens", average.cast("long").alias("avg_output_per_session"), share(F.col("total_output_tokens"), F.col("whole")).alias("pct_of_total"))


def subagent_breakdown(tool_calls: DataFrame, sessions: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Commands of subagent sessions by category, bounded by each call's own UTC day."""
    calls = tool_calls.join(sessions.filter("subagent").select("session_id"), "session_id", "left_semi")
    if since or until:
        calls = calls.withColumn("day", F.to_date(F.try_to_timestamp("timestamp")).cast("string")).filter(days(since, until))
    counted = calls.groupBy(command_category(F.col("command")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n").alias("whole"))
    return counted.join(F.broadcast(whole)).select("category", "n", share(F.col("n"), F.col("whole")).alias("pct")).orderBy(F.desc("n"), "category")


def by_repo(sessions: DataFrame, limit: int = 10) -> DataFrame:
    """Repositories by output tokens; the percentage is of all tokens."""
    sums = sessions.groupBy(F.coalesce("repo_name", F.lit("(no repo)")).alias("repo_name")).agg(
        F.count(F.lit(1)).alias("session_count"), _total("total_output_tokens"), _total("total_input_tokens"))
    whole = sums.agg(F.sum("total_output_tokens").alias("whole"))
    out = sums.join(F.broadcast(whole)).select("repo_name", "session_count", "total_output_tokens", "total_input_tokens", share(F.col("total_output_tokens"), F.col("whole")).alias("pct_of_total"))
    return out.orderBy(F.desc("total_output_tokens"), "repo_name").limit(limit)


def by_period(daily: DataFrame, today: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Months with tokens for each calendar day; nothing unless the days span more than 30.

    A month counts its days within the bounds and up to `today`, at least one.
    """
    rows = daily.filter(days(since, until))
    month = F.substring("day", 1, 7)
    sums = rows.groupBy(month.alias("month")).agg(F.countDistinct("session_id").alias("session_count"), *map(_total, SUMS), F.min("day").alias("low"), F.max("day").alias("high"))
    span = sums.agg(F.datediff(F.to_date(F.max("high")), F.to_date(F.min("low"))).alias("span"))
    first = F.to_date(F.concat("month", F.lit("-01")))
    begin = F.greatest(first, F.to_date(F.lit(since[:10]))) if since else first
    ends = [F.last_day(first), F.to_date(F.lit(today))] + ([F.to_date(F.lit(until[:10]))] if until else [])
    calendar = F.greatest(F.lit(1), F.datediff(F.least(*ends), begin) + 1)
    long = sums.join(F.broadcast(span)).filter("span > 30").withColumn("calendar_days", calendar.cast("long"))
    return long.select("month", "session_count", *SUMS, "calendar_days", F.expr("total_output_tokens div calendar_days").alias("tokens_per_day")).orderBy("month")


def dashboard(sessions: DataFrame) -> DataFrame:
    """Totals of listed sessions; sums over nothing stay null."""
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("username").alias("users"), *[F.sum(c).cast("long").alias(c) for c in ("user_message_count", "tool_call_count", "error_count", "total_output_tokens")])


def day_counts(sessions: DataFrame, limit: int = 7) -> DataFrame:
    """Sessions of each start day, newest first."""
    return sessions.filter("first_timestamp is not null").groupBy(F.substring("first_timestamp", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("day")).limit(limit)


def landing(sessions: DataFrame, limit: int = 14) -> DataFrame:
    """Sessions and tokens of the newest days, whatever their visibility."""
    return sessions.filter("first_timestamp is not null").groupBy(F.substring("first_timestamp", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("sessions"), _total("total_output_tokens")).orderBy(F.desc("day")).limit(limit)


def pivoted_days(rows: DataFrame, by: str, values: list[str], measure: str, today: str, back: int = 30) -> DataFrame:
    """A row for each day from `back` days before today and a column for each value, zero where nothing is."""
    recent = rows.filter(F.col("day") >= F.date_sub(F.to_date(F.lit(today)), back).cast("string"))
    wide = recent.groupBy("day").pivot(by, values).agg(F.sum(measure))
    return wide.na.fill(0).select("day", *[F.col(f"`{v}`").cast("long").alias(v) for v in values])


def user_labels(users: DataFrame) -> DataFrame:
    """username, label: the display name, with the handle where others share it."""
    name = F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), "username")
    same = F.count(F.lit(1)).over(Window.partitionBy("name"))
    return users.select("username", name.alias("name")).withColumn("n", same).select("username", F.when(F.col("n") > 1, F.concat("name", F.lit(" (@"), "username", F.lit(")"))).otherwise(F.col("name")).alias("label"))


def top_tools(tool_calls: DataFrame, sessions: DataFrame, limit: int = 20) -> DataFrame:
    """Tools by calls in the given (listed) sessions."""
    calls = tool_calls.join(sessions.select("session_id"), "session_id", "left_semi")
    return calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "tool_name").limit(limit)


def error_rates(sessions: DataFrame, limit: int = 15) -> DataFrame:
    return sessions.groupBy("username").agg(F.sum("error_count").cast("long").alias("errors"), F.sum("tool_call_count").cast("long").alias("tools")).orderBy(F.desc("errors"), "username").limit(limit)


def users(users_: DataFrame, sessions: DataFrame, extra: Column | None = None) -> DataFrame:
    """Users with their listed sessions; users without any keep a row."""
    listed = (sessions if extra is None else sessions.filter(extra)).select("username", "session_id", "last_timestamp", "user_message_count", "total_output_tokens")
    sums = listed.groupBy("username").agg(F.count("session_id").alias("sessions"), F.max("last_timestamp").alias("last_seen"), F.sum("user_message_count").alias("m"), F.sum("total_output_tokens").alias("t"))
    out = users_.select("username").join(sums, "username", "left").select("username", zero(F.col("sessions")).alias("sessions"), "last_seen", zero(F.col("m")).cast("long").alias("messages"), zero(F.col("t")).cast("long").alias("output_tokens"))
    return out.orderBy(F.desc_nulls_last("last_seen"), F.desc("sessions"), "username")


def user_summary(sessions: DataFrame, daily: DataFrame) -> DataFrame:
    """Per user: totals, conditional counts and statuses; active days are distinct event days."""
    status = [F.sum(F.when(F.col("session_status") == s, 1).otherwise(0)).alias(f"{s}_sessions") for s in ("success", "partial", "failed", "exploration")]
    sums = sessions.groupBy("username").agg(
        F.count(F.lit(1)).alias("sessions"), F.countDistinct("repo_name").alias("repos"), F.countDistinct(F.when(F.col("error_count") > 0, F.col("session_id"))).alias("sessions_with_errors"),
        *[F.sum(c).cast("long").alias(c) for c in ("user_message_count", "tool_call_count", "error_count", "total_output_tokens")], *status, F.min("first_timestamp").alias("first_seen"), F.max("first_timestamp").alias("last_seen"))
    active = daily.join(sessions.select("session_id", "username"), "session_id").groupBy("username").agg(F.countDistinct("day").alias("active_days"))
    return sums.join(active, "username", "left").withColumn("active_days", zero(F.col("active_days")))


def user_activity(daily: DataFrame, sessions: DataFrame, username: str, limit: int = 60) -> DataFrame:
    own = sessions.filter(F.col("username") == username).select("session_id")
    rows = daily.join(own, "session_id", "left_semi").groupBy("day")
    return rows.agg(F.countDistinct("session_id").alias("sessions"), *[F.sum(c).cast("long").alias(c) for c in ("user_message_count", "tool_call_count")]).orderBy(F.desc("day")).limit(limit)


def user_mix(rows: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """Rows of each value of `by`, most first."""
    out = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)
    return out.limit(limit) if limit else out


def user_stats(sessions: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("long").alias(c) for c in ("user_message_count", "tool_call_count", "error_count", "total_output_tokens")]
    return sessions.groupBy("username").agg(F.count(F.lit(1)).alias("sessions"), *sums, F.first("display_name", ignorenulls=True).alias("display_name")) if "display_name" in sessions.columns else sessions.groupBy("username").agg(F.count(F.lit(1)).alias("sessions"), *sums)


def bash_commands(tool_calls: DataFrame, tools: tuple[str, ...] = ("Bash", "shell", "bash"), limit: int = 30, width: int = 80) -> DataFrame:
    """Shell commands by count; they are squeezed and cut after grouping."""
    counted = tool_calls.filter(F.col("tool_name").isin(*tools) & F.col("command").isNotNull() & (F.col("command") != "")).groupBy("command").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "command").limit(limit)
    return counted.select(F.substring(F.trim(F.regexp_replace("command", r"\s+", " ")), 1, width).alias("command"), "n")


def shared_utilities(tool_calls: DataFrame, sessions: DataFrame, least: int = 2, limit: int = 30) -> DataFrame:
    """Commands that several users run."""
    rows = tool_calls.filter(F.col("command").isNotNull() & (F.col("command") != "")).join(sessions.select("session_id", "username"), "session_id")
    counted = rows.groupBy("command").agg(F.countDistinct("username").alias("users"), F.count(F.lit(1)).alias("total"))
    return counted.filter(F.col("users") >= least).orderBy(F.desc("users"), F.desc("total"), "command").limit(limit)


def runaways(sessions: DataFrame, limit: int = 8) -> DataFrame:
    """Sessions with very many calls or errors, worst first."""
    tools, errors = zero(F.col("tool_call_count")), zero(F.col("error_count"))
    hit = sessions.filter((tools >= 200) | (errors >= 25) | ((tools >= 100) & (errors >= 10)))
    out = hit.withColumn("score", (5 * errors + tools).cast("long"))
    return out.orderBy(F.desc("score"), F.desc_nulls_last("duration_seconds"), F.desc("first_timestamp"), "session_id").limit(limit).select("session_id", "username", "tool_call_count", "error_count", "score")


def relaunches(sessions: DataFrame, least: int = 2, limit: int = 20, since: str | None = None) -> DataFrame:
    """Objective families that were launched again, since a time stamp where one is given, with the latest session of each."""
    sessions = sessions if since is None else sessions.filter(F.col("first_timestamp") >= since)
    latest = F.struct("first_timestamp", "session_id")
    groups = sessions.filter(F.col("objective_family").isNotNull()).groupBy("objective_family").agg(
        F.count(F.lit(1)).alias("launches"), F.countDistinct("username").alias("operators"), F.sum("tool_call_count").cast("long").alias("tools"), F.sum("error_count").cast("long").alias("errors"),
        F.max(latest).alias("latest"), F.max_by("objective_label", latest).alias("label"))
    out = groups.filter(F.col("launches") >= least).select("objective_family", "launches", "operators", "tools", "errors", F.col("latest.session_id").alias("latest_session_id"), F.col("latest.first_timestamp").alias("latest_timestamp"), "label")
    return out.orderBy(F.desc("launches"), F.desc("latest_timestamp"), "objective_family").limit(limit)


PROJECT = ("username", "source", "project", "repo_name", "workspace_root")


def projects(sessions: DataFrame, paths: DataFrame, key: tuple[str, ...] = PROJECT) -> DataFrame:
    """Sessions and distinct paths of each project key, in which null and '' are one value."""
    named = sessions.select("session_id", "user_message_count", "last_timestamp", *[F.coalesce(k, F.lit("")).alias(k) for k in key])
    sums = named.groupBy(*key).agg(F.count(F.lit(1)).alias("sessions"), F.sum("user_message_count").cast("long").alias("messages"), F.max("last_timestamp").alias("last_seen"))
    touched = paths.join(named.select("session_id", *key), "session_id").groupBy(*key).agg(F.countDistinct("normalized_path").alias("unique_paths"))
    return sums.join(touched, list(key), "left").withColumn("unique_paths", zero(F.col("unique_paths")))


def repos(sessions: DataFrame, paths: DataFrame) -> DataFrame:
    known = sessions.filter(F.coalesce("repo_name", F.lit("")) != "")
    sums = known.groupBy("repo_name").agg(
        F.count(F.lit(1)).alias("sessions"), F.countDistinct("worktree_root").alias("worktrees"), F.countDistinct("branch").alias("branches"),
        F.sum("assistant_message_count").cast("long").alias("messages"), F.max("last_timestamp").alias("last_seen"))
    touched = paths.join(known.select("session_id", "repo_name"), "session_id").groupBy("repo_name").agg(F.countDistinct("normalized_path").alias("unique_paths"))
    return sums.join(touched, "repo_name", "left").withColumn("unique_paths", zero(F.col("unique_paths"))).orderBy(F.desc("last_seen"), "repo_name")


def paths(rows: DataFrame, limit: int = 200) -> DataFrame:
    """Paths by occurrences, split by operation."""
    split = [F.sum(F.when(F.col("operation") == o, F.col("occurrence_count")).otherwise(0)).cast("long").alias(f"{o}s") for o in ("write", "read", "search")]
    return rows.groupBy("normalized_path").agg(F.countDistinct("session_id").alias("sessions"), F.sum("occurrence_count").cast("long").alias("occurrences"), *split).orderBy(F.desc("occurrences"), "normalized_path").limit(limit)


def source_status(sessions: DataFrame) -> DataFrame:
    """Sessions and public sessions of each source."""
    return sessions.groupBy("source").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.when(F.col("visibility") == "public", 1).otherwise(0)).alias("public_sessions"), F.sum(F.when(F.col("error_count") > 0, 1).otherwise(0)).alias("with_errors"))


def github_totals(daily: DataFrame, username: str) -> DataFrame:
    return daily.filter(F.col("username") == username).agg(F.sum("commits").alias("commits"), F.sum("pull_requests").alias("pull_requests"), F.count(F.lit(1)).alias("days"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50, most: int = 200) -> DataFrame:
    """One page of an ordered list; sizes and numbers are clamped."""
    size = min(max(1, size), most)
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def stats(sessions: DataFrame, daily: DataFrame, tool_calls: DataFrame, today: str, username: str | None = None, since: str | None = None, until: str | None = None) -> dict[str, DataFrame]:
    """All five usage reports, lazily."""
    own = sessions.filter(F.col("username") == username) if username else sessions
    bounded = since is not None or until is not None
    scope = own if bounded else own.filter(since_until(since, until))
    used = daily.join(own.select("session_id"), "session_id", "left_semi")
    return {
        "overview": overview(scope, used, since, until),
        "by_pattern": by_pattern(scope, used, since, until),
        "subagent_breakdown": subagent_breakdown(tool_calls, scope, since, until),
        "by_repo": by_repo(scope),
        "by_period": by_period(used, today, since, until),
    }


# Sections of the printed report, as title and columns (heading, column, width, form).
SECTIONS = {
    "by_pattern": ("By behavioral pattern", (("Pattern", "pattern", 22, str), ("Sessions", "session_count", 10, "{:,}"), ("Output", "total_output_tokens", 14, "{:,}"), ("%", "pct_of_total", 8, "{:.1f}%"), ("Avg/sess", "avg_output_per_session", 12, "{:,}"))),
    "subagent_breakdown": ("Subagent command breakdown", (("Category", "category", 16, str), ("Commands", "n", 10, "{:,}"), ("%", "pct", 8, "{:.1f}%"))),
    "by_repo": ("By repo (top 10)", (("Repo", "repo_name", 30, str), ("Sessions", "session_count", 10, "{:,}"), ("Output", "total_output_tokens", 14, "{:,}"), ("%", "pct_of_total", 8, "{:.1f}%"))),
    "by_period": ("By month (event-dated)", (("Month", "month", 10, str), ("Sessions", "session_count", 10, "{:,}"), ("Input", "total_input_tokens", 16, "{:,}"), ("Output", "total_output_tokens", 14, "{:,}"), ("Tok/day", "tokens_per_day", 12, "{:,}"))),
}
TOTALS = (("Input tokens", "total_input_tokens"), ("Output tokens", "total_output_tokens"), ("Cached tokens", "cached_input_tokens"), ("Cache writes", "cache_creation_input_tokens"), ("Repos touched", "repos_touched"))


def stats_text(bundle: dict[str, DataFrame]) -> list[str]:
    """Lines of the reports of `stats`. Each has a row for a class, a category, one of ten repositories or a month, so
    what reaches the driver does not grow with the sessions."""
    def cell(value, width: int, form) -> str:
        if form is str:
            return f"{value if len(value) <= width - 2 else value[:width - 5] + '...':<{width}}"
        return f"{form.format(value):>{width}}"

    total = bundle["overview"].first()
    pairs = [("Sessions", f"{total.total_sessions:,}"), ("Date range", " to ".join((d or "?")[:10] for d in (total.first_date, total.last_date)))]
    out = ["=== Overview ===", *[f"  {name + ':':<16}{value}" for name, value in pairs + [(n, f"{total[c]:,}") for n, c in TOTALS]]]
    for name, (title, columns) in SECTIONS.items():
        rows = bundle[name].collect()
        if rows:
            heads = [f"{h:<{w}}" if form is str else f"{h:>{w}}" for h, _, w, form in columns]
            shown = [r for r in rows if name != "by_pattern" or r.session_count]
            out += ["", f"=== {title} ===", "  " + "".join(heads), *["  " + "".join(cell(r[c], w, form) for _, c, w, form in columns) for r in shown]]
    return out
