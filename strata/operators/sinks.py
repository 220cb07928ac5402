"""Keyed writes of the catalog as set operations, and versioned table storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.classify import zero

# Visibility columns that an ingest may not overwrite.
GUARDED = ("visibility", "visibility_source", "reviewed_hash", "reviewed_metadata_hash")
PATH_KEY = ("session_id", "normalized_path", "operation", "source", "tool_name")


def upsert(old: DataFrame, new: DataFrame, key: str = "session_id", guarded: tuple[str, ...] = ()) -> DataFrame:
    """All old and new rows; for a key in both the new row, but the guarded columns of the old one."""
    held = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in guarded], F.lit(True).alias("_was"))
    taken = new.join(held, key, "left").withColumns({c: F.when(F.col("_was"), F.col(f"_old_{c}")).otherwise(F.col(c)) for c in guarded}).select(*new.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(taken, allowMissingColumns=True)


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions after an ingest. A manual visibility stays; a public session whose artifact or metadata
    changed becomes unlisted with source `source_drift`."""
    held = old.select("session_id", *[F.col(c).alias(f"_old_{c}") for c in GUARDED])
    manual, public = F.col("_old_visibility_source") == "manual", F.col("_old_visibility") == "public"
    drift = public & (~F.col("file_hash").eqNullSafe(F.col("_old_reviewed_hash")) | ~F.col("metadata_hash").eqNullSafe(F.col("_old_reviewed_metadata_hash")))
    next_, source = F.when(drift, "unlisted").when(manual | public, F.col("_old_visibility")).otherwise(F.col("visibility")), \
        F.when(drift, "source_drift").when(manual | public, F.col("_old_visibility_source")).otherwise(F.col("visibility_source"))
    joined = new.join(held, "session_id", "left").withColumns({
        "visibility": F.coalesce(next_, F.col("visibility")), "visibility_source": F.coalesce(source, F.col("visibility_source")),
        "reviewed_hash": F.coalesce("_old_reviewed_hash", "reviewed_hash"), "reviewed_metadata_hash": F.coalesce("_old_reviewed_metadata_hash", "reviewed_metadata_hash")})
    return old.join(new.select("session_id"), "session_id", "left_anti").unionByName(joined.select(*new.columns), allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of all sessions after those of `sessions` were replaced by `new`."""
    return old.join(sessions.select(key).distinct(), key, "left_anti").unionByName(new)


def affected_claims(old: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with a claim on any key that the replaced sessions held or hold."""
    keys = old.join(sessions.select("session_id"), "session_id", "left_semi").select("claim_key").unionByName(new.select("claim_key")).distinct()
    return old.unionByName(new).join(keys, "claim_key", "left_semi").select("session_id").distinct()


def aggregate_paths(rows: DataFrame, order: str = "seq", key: tuple[str, ...] = PATH_KEY) -> DataFrame:
    """One row per path use: forms of its first occurrence, first and last time stamp, occurrences."""
    forms = [F.min_by(c, order).alias(c) for c in ("raw_path", "relative_path", "display_path") if c in rows.columns]
    return rows.groupBy(*key).agg(*forms, F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.count(F.lit(1)).alias("occurrence_count"))


def backup_plan(files: DataFrame, sha: str = "sha256", order: str = "path") -> DataFrame:
    """Files to store: of equal contents the first."""
    first = files.groupBy(sha).agg(F.min(order).alias("_first")).withColumnRenamed(sha, "_sha")
    return files.join(first, (F.col(sha) == F.col("_sha")) & (F.col(order) == F.col("_first")), "left_semi").dropDuplicates([sha])


def plan_totals(plan: DataFrame, by: str = "source", size: str = "size") -> DataFrame:
    return plan.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("bytes"))


def object_key(sha: Column, name: Column, known: tuple[str, ...] = (".jsonl", ".json", ".gz", ".zst", ".sqlite", ".db", ".txt", ".md")) -> Column:
    """Content-addressed key; other suffixes become .bin."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return F.concat(F.lit("raw/sha256/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.when(suffix.isin(*known), suffix).otherwise(".bin"))


def file_id(relative: Column, sha: Column) -> Column:
    return F.sha2(F.concat(relative, F.lit("\0"), sha), 256)


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def next_available(names: DataFrame, name: str = "username") -> DataFrame:
    """Rows with case-insensitive name clashes resolved: the first keeps the name, others get -2, -3, ..."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(name))
    return names.withColumn("_n", place).withColumn("new_name", F.when(F.col("_n") == 1, F.lower(name)).otherwise(F.concat(F.lower(name), F.lit("-"), F.col("_n")))).drop("_n")


def migrate(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`rows` with every column of `wanted` (an empty frame of the present schema); own columns stay."""
    return wanted.limit(0).unionByName(rows, allowMissingColumns=True)


def versions(column: str, current: int) -> Column:
    """Rows that an older version of a derivation made."""
    return zero(F.col(column)) < current
