"""Line deduplication with DataFrame functions only.

Lines are exploded with a normalised key, the key is hashed (two independent 64-bit hashes), distinct
documents are counted for each hash in two aggregations that both combine map-side, and documents are
put together again by position from the lines that stay. Only hashes travel; the text of a document is
shuffled once, to meet the positions that it loses.

Cases: null text counts as empty, which is one empty line; rows repeated under one id count as one
document, and all of them keep or lose their lines alike; a null id counts as a document that any other
id exceeds; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import SPACES, ascii_lower, staged, text_or_empty


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc_id, xx, pos, h1, h2 of every line whose key is long enough."""
    lowered = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("xx"), F.posexplode(F.split(ascii_lower(text_or_empty(text_col)), "\n")).alias("pos", "line"))
    keyed = lowered.select("doc_id", "xx", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "xx", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text; one row per row of `docs`."""
    lines = keyed_lines(docs, id_col, text_col, min_chars)
    per_doc = lines.select("h1", "h2", "doc_id").distinct()
    common = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("holder")).filter(F.col("docs") >= min_docs)
    common = staged(common.drop("docs"), "common_lines")
    lost = lines.join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    # A row's positions come once however often the row is repeated.
    drops = lost.groupBy("doc_id", "xx").agg(F.collect_set("pos").alias("drops")).withColumnsRenamed({"doc_id": "d", "xx": "x"})
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("xx"), F.split(text_or_empty(text_col), "\n").alias("lines"))
    met = base.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xx") == F.col("x")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drops", F.array().cast("array<int>")))
    kept = F.when(F.col("drops").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
