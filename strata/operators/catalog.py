"""The catalog's views: visibility flags, effective days, and owners of shared usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Counters of a day or session.
TOKENS = ("total_input_tokens", "total_output_tokens", "cached_input_tokens", "cache_creation_input_tokens")
COUNTS = ("user_message_count", "assistant_message_count", "tool_call_count")


def session_catalog(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with their user's settings and what each read mode may list or show.

    A session without a user row has a public profile and unlisted sessions by default.
    """
    seen, profile = F.col("visibility"), F.coalesce("profile_visibility", F.lit("public"))
    open_ = seen.isin("public", "unlisted")
    joined = sessions.join(users.select("username", "display_name", "profile_visibility", "default_visibility"), "username", "left")
    return joined.withColumns({
        "profile_visibility": profile,
        "default_visibility": F.coalesce("default_visibility", F.lit("unlisted")),
        "listed_public": F.coalesce((seen == "public") & (profile == "public"), F.lit(False)),
        "listed_private": F.coalesce(open_, F.lit(False)),
        "direct_private": F.coalesce(open_, F.lit(False)),
        "direct_public": F.coalesce((seen == "public") & profile.isin("public", "unlisted"), F.lit(False)),
    })


def user_catalog(users: DataFrame) -> DataFrame:
    profile = F.col("profile_visibility")
    return users.withColumns({"listed_public": profile == "public", "listed_private": F.lit(True), "direct_public": profile.isin("public", "unlisted"), "direct_private": F.lit(True)})


def directly_visible(users: DataFrame, sessions: DataFrame, public: bool = True) -> DataFrame:
    """Users whose profile may be opened: all in private mode; in public mode those whose profile allows it and who have a session that
    may be opened, since a profile is reviewed with a published session."""
    if not public:
        return users
    opened = session_catalog(sessions, users).filter("direct_public").select("username")
    return user_catalog(users).filter("direct_public").select(*users.columns).join(opened, "username", "left_semi")


def daily_effective(daily: DataFrame, sessions: DataFrame, measures: tuple[str, ...] = TOKENS + COUNTS) -> DataFrame:
    """Day rows, and for sessions with a time stamp but no day row their totals on the first day."""
    real = daily.select("session_id", "day", *measures, F.lit(0).alias("approximated"))
    missing = sessions.filter(F.col("first_timestamp").isNotNull() & (F.col("first_timestamp") != "")).join(daily.select("session_id").distinct(), "session_id", "left_anti")
    whole = missing.select("session_id", F.substring("first_timestamp", 1, 10).alias("day"), *measures, F.lit(1).alias("approximated"))
    return real.unionByName(whole)


def session_rank(last: Column, first: Column, session_id: Column) -> Column:
    """Least first: sessions without stamps come last."""
    return F.struct(F.coalesce(last, F.lit("~")).alias("l"), F.coalesce(first, F.lit("~")).alias("f"), session_id.alias("s"))


def claim_owners(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """claim_key, session_id: of the sessions that hold a message, the one of least rank owns it.

    One aggregation per key; claims of unknown sessions never own.
    """
    known = claims.select("claim_key", "session_id").join(sessions.select("session_id", "first_timestamp", "last_timestamp"), "session_id")
    rank = session_rank(F.col("last_timestamp"), F.col("first_timestamp"), F.col("session_id"))
    return known.groupBy("claim_key").agg(F.min(rank).alias("least")).select("claim_key", F.col("least.s").alias("session_id"))


def native_usage(claims: DataFrame, sessions: DataFrame, measures: tuple[str, ...], by_day: bool = False) -> DataFrame:
    """Usage that counts every message once: owned claims where a session is accounted by claims
    (`uses_claims`), else its own totals."""
    keys = ["session_id", "day"] if by_day else ["session_id"]
    owned = claims.join(claim_owners(claims, sessions), ["claim_key", "session_id"])
    sums = owned.groupBy(*keys).agg(*[F.sum(m).alias(f"native_{m}") for m in measures])
    if by_day:
        return sums.join(sessions.filter("uses_claims").select("session_id"), "session_id", "left_semi")
    joined = sessions.select("session_id", "uses_claims", *measures).join(sums, "session_id", "left")
    native = [F.when(F.col("uses_claims"), F.coalesce(f"native_{m}", F.lit(0))).otherwise(F.col(m)).alias(f"native_{m}") for m in measures]
    return joined.select("session_id", *native)


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
