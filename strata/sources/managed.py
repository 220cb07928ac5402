"""Transcripts whose source may be gone: which file a session is read from, and what has to wait."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.sources.bounded import hashed_files
from strata.sources.store import staged

COPY = "file string, copy string, sha256 string"
RETRY = "file string, reason string, tries int"


def resolve(due: DataFrame, present: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the files that are due to be read (file): where each can be read, (file, path, via), and which cannot, (file, reason).

    A source that is still there comes first, then a managed copy (file, copy, sha256) whose bytes have the hash on record. A copy
    that is missing, unreadable or other than it was recorded is not read: its file waits with the reason. Only copies of
    files without a source are hashed.
    """
    here = due.join(present.select("file").distinct(), "file", "left_semi").select("file", F.col("file").alias("path"), F.lit("source").alias("via"))
    lost = due.select("file").join(present, "file", "left_anti").join(copies, "file", "left")
    sums = hashed_files(lost.filter("copy is not null").select(F.col("copy").alias("file")).distinct()).select(F.col("file").alias("copy"), F.col("sha256").alias("found"))
    told = staged(lost.join(sums, "copy", "left"), "copies_due")
    reason = F.when(F.col("copy").isNull(), "gone").when(F.col("found").isNull(), "unreadable").when(F.col("found") != F.col("sha256"), "hash differs")
    reason = F.when(F.col("copy").isNotNull() & F.col("sha256").isNull(), "no hash on record").otherwise(reason)
    told = told.withColumn("reason", reason)
    return here.unionByName(told.filter("reason is null").select("file", F.col("copy").alias("path"), F.lit("copy").alias("via"))), told.filter("reason is not null").select("file", "reason")


def retried(held: DataFrame, tried: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows (file, reason, tries) of files that wait, after one more round over the files of `tried`: a file that was read leaves."""
    rows = failed.join(held.select("file", F.col("tries").alias("was")), "file", "left")
    counted = rows.select("file", "reason", (F.coalesce("was", F.lit(0)) + 1).cast("int").alias("tries"))
    return held.join(tried.select("file"), "file", "left_anti").unionByName(counted)
