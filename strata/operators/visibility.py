"""Visibility rules, their resolution, and guarded transitions with an audit."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.classify import squeeze

# Match modes, and the default threshold of a fuzzy match.
MODES = ("equals", "contains", "prefix", "suffix", "regex", "fuzzy")
THRESHOLD = 0.7
LEVELS = ("private", "unlisted", "public")


def similarity(a: str, b: str) -> float:
    """1 of equal texts, 0.98 of a part, else the best of character, compact and word likeness."""
    a, b = (" ".join("".join(c if c.isalnum() else " " for c in (x or "").lower()).split()) for x in (a, b))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.98
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    words = set(a.split()), set(b.split())
    return max(ratio(a, b), ratio(a.replace(" ", ""), b.replace(" ", "")), len(words[0] & words[1]) / len(words[0] | words[1]))


@F.arrow_udf(T.DoubleType())
def fuzzy(values: pa.Array, patterns: pa.Array) -> pa.Array:
    return pa.array([similarity(v, p) for v, p in zip(values.to_pylist(), patterns.to_pylist())], pa.float64())


def match_score(mode: str, pattern: str, value: Column, threshold: float | None = None) -> Column:
    """Score of one rule on a value, null without a match. The pattern is part of the plan."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    low, want = F.lower(squeeze(value)), " ".join(pattern.split()).lower()
    if mode == "regex":
        try:
            import re
            re.compile(pattern)
        except re.error:
            return F.lit(None).cast("double")
        hit = F.regexp_like(F.coalesce(value, F.lit("")), F.lit(f"(?i){pattern}"))
    elif mode == "fuzzy":
        score = fuzzy(value, F.lit(pattern))
        return F.when(score >= (THRESHOLD if threshold is None else threshold), score)
    else:
        hit = {"equals": low == want, "contains": low.contains(want), "prefix": low.startswith(want), "suffix": low.endswith(want)}[mode]
    return F.when(hit & (low != "") & F.lit(bool(want)), 1.0)


def resolve(sessions: DataFrame, rules: list[dict]) -> DataFrame:
    """session_id, visibility, rule_id, reason: the first enabled rule by (priority, id) of the session's
    source that matches, else the user's default. Rules are configuration; a few dozen at most."""
    chain, rule = F.lit(None).cast("string"), F.lit(None).cast("int")
    for r in sorted((r for r in rules if r.get("enabled", True)), key=lambda r: (r["priority"], r["id"]), reverse=True):
        hit = match_score(r["mode"], r["pattern"], F.col(r["field"]), r.get("threshold")).isNotNull()
        if r.get("source_scope", "all") != "all":
            hit = hit & (F.col("source") == r["source_scope"])
        chain, rule = F.when(hit, r["visibility"]).otherwise(chain), F.when(hit, r["id"]).otherwise(rule)
    level = F.coalesce(chain, F.col("default_visibility"), F.lit("unlisted"))
    reason = F.when(rule.isNotNull(), F.concat(F.lit("rule "), rule)).otherwise("user default")
    return sessions.select("session_id", level.alias("visibility"), rule.alias("rule_id"), reason.alias("reason"))


def recompute(sessions: DataFrame, rules: list[dict]) -> DataFrame:
    """Sessions with the visibility that rules give. Manual ones stay; public without a review is unlisted."""
    new = resolve(sessions, rules).select("session_id", F.col("visibility").alias("_next"), "reason")
    level = F.when(F.col("visibility_source") == "manual", F.col("visibility")).when((F.col("_next") == "public") & ~F.coalesce(F.col("reviewed_hash").eqNullSafe(F.col("file_hash")) & F.col("reviewed_hash").isNotNull(), F.lit(False)), "unlisted").otherwise(F.col("_next"))
    return sessions.join(new, "session_id").withColumn("next_visibility", level).drop("_next")


def transition(sessions: DataFrame, wanted: DataFrame, actor: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(sessions after, audit rows) of wanted levels (session_id, target).

    Public needs a review of the present file and metadata; anything else is always allowed.
    """
    joined = sessions.join(wanted, "session_id", "left")
    reviewed = F.col("reviewed_hash").isNotNull() & F.col("reviewed_hash").eqNullSafe(F.col("file_hash")) & F.col("reviewed_metadata_hash").eqNullSafe(F.col("metadata_hash"))
    asked = F.col("target").isNotNull() & (F.col("target") != F.col("visibility"))
    good = F.col("target").isin(*LEVELS) & ((F.col("target") != "public") | reviewed)
    rows = joined.withColumn("_asked", asked).withColumn("_good", F.coalesce(asked & good, F.lit(False)))
    after = rows.select(*[F.when(F.col("_good"), F.col("target")).otherwise(F.col("visibility")).alias(c) if c == "visibility" else F.when(F.col("_good"), F.lit("manual")).otherwise(F.col(c)).alias(c) if c == "visibility_source" else F.col(c) for c in sessions.columns])
    audit = rows.filter("_asked").select("session_id", F.col("visibility").alias("from_visibility"), F.col("target").alias("to_visibility"), F.when(F.col("_good"), "applied").otherwise("refused").alias("outcome"), F.lit(actor).alias("actor"), F.lit(at).alias("at"))
    return after, audit


def drifted(sessions: DataFrame) -> DataFrame:
    """Public sessions whose file or metadata is no longer the reviewed one."""
    same = F.col("reviewed_hash").eqNullSafe(F.col("file_hash")) & F.col("reviewed_metadata_hash").eqNullSafe(F.col("metadata_hash"))
    return sessions.filter((F.col("visibility") == "public") & ~same).select("session_id", F.lit("unlisted").alias("target"))


def public_reads(sessions: DataFrame) -> DataFrame:
    """Sessions that may be served: public, of the reviewed bytes and metadata."""
    return sessions.filter((F.col("visibility") == "public") & F.col("reviewed_hash").isNotNull() & F.col("reviewed_hash").eqNullSafe(F.col("file_hash")) & F.col("reviewed_metadata_hash").eqNullSafe(F.col("metadata_hash")))
