"""Quality rules with verdicts on whole hosts.

Each document is measured once (an Arrow pass that keeps nothing between batches) and the measures are
staged. Rule failures are summed for each host with map-side combine. For each rule a beta prior is
fitted to the hosts by moments, and each host's failure rate shrinks towards it: a host with few
documents stays near the mean of all hosts. A host whose shrunk rate of some rule exceeds `host_limit`
is rejected, and its verdict is joined back to its documents. Hosts are staged before the join, so Spark
broadcasts them only where their written size is within its limit, and else splits a hot host's rows.

Cases: null text has no words; a null host is a host of its own; repeated rows are measured as
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import as_rows, longs, parts, prefix_sums, span_hash, staged, trim, utf8, windows, word_hashes

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = longs("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(x) for x in SYMBOLS]] = 1
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_IN_WORD = np.ones(256, np.int64)
_IN_WORD[_SPACES] = 0
_IN_WORD[0x80:0xC0] = 0  # continuation bytes: a code point counts once


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, its words in WINDOW-word windows that the text holds twice or more."""
    hashes = windows(words, WINDOW)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if not len(hashes):
        return np.zeros(len(at) - 1, np.int64)
    whole = np.flatnonzero(doc[: len(hashes)] == doc[WINDOW - 1 :])
    key, owner = hashes[whole], doc[whole]
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = whole[order[twice]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return _sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), at)


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, its \n-split lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, starts)])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    inside = np.concatenate([[0], np.cumsum(~_SPACES[data])])
    said = inside[ends] > inside[starts]
    starts, ends, owner = starts[said], ends[said], owner[said]
    key = span_hash(prefix_sums(data), starts, ends)
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner[order][1:][same], minlength=len(offsets) - 1).astype(np.int64)


@F.arrow_udf(MEASURES)
def measures(texts: pa.Array) -> pa.Array:
    data, offsets = utf8(texts)
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for i, j in parts(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words, at = word_hashes(d, o, lower=False)
        for held, x in zip(out, (np.diff(at), _sums(_IN_WORD[d], o), _sums(_SYMBOL[d], o), repeated_lines(d, o), repeated_words(words, at))):
            held.append(x)
    trim()
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], MEASURES.names)


def base_rules() -> dict[str, Column]:
    few = F.col("n_words") < 10
    return {"few_words": few, "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words")}


def host_rules() -> dict[str, Column]:
    """Rules whose failures are summed by host. The last three count against a host only."""
    words = F.col("n_words")
    return base_rules() | {
        "symbols": 10 * F.col("n_symbols") > words,
        "dup_lines": 10 * F.col("n_dup_lines") > words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words)}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), measures(text_col).alias("m")).select("doc_id", "host", "m.*")


def host_verdicts(rows: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """host, docs, the shrunk failure rate of each rule, host_ok."""
    rules = host_rules()
    fails = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.when(c, 1).otherwise(0)).alias(r) for r, c in rules.items()])
    fails = staged(fails, "host_failures")
    rate = {r: F.col(r) / F.col("docs") for r in rules}
    stats = fails.agg(F.avg(1 / F.col("docs")).alias("inv"), *[f(x).alias(f"{n}_{r}") for r, x in rate.items() for n, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    shrunk = {}
    for r in rules:
        mean, var, inv = stats[f"mean_{r}"] or 0.0, stats[f"var_{r}"] or 0.0, stats["inv"] or 1.0
        # Moments: Var(rate) = mean (1 - mean) (inv + (1 - inv) / (strength + 1)), solved for the prior's strength.
        spread = mean * (1 - mean)
        between = max(var - spread * inv, 1e-9) / max(1 - inv, 1e-9)
        strength = min(max(spread / between - 1, 1.0), 1e4)
        shrunk[r] = (F.col(r) + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    worst = functools.reduce(operator.or_, [F.col(f"rate_{r}") > host_limit for r in rules])
    return fails.select("host", "docs", *[x.alias(f"rate_{r}") for r, x in shrunk.items()]).withColumn("host_ok", ~worst)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """One row per row of `docs`: doc_id, the measures, base_failed, host_ok, kept."""
    rows = staged(measured(docs, id_col, text_col, host_col), "measures")
    hosts = staged(host_verdicts(rows, host_limit).select(F.col("host").alias("h"), "host_ok"), "hosts")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
    failed = functools.reduce(operator.or_, base_rules().values())
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "host_ok", (~failed & F.col("host_ok")).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """`docs` without the rows that the rules reject, columns unchanged.

    Hosts are judged in a first pass; the second measures each row beside its own text.
    """
    rows = staged(measured(docs, id_col, text_col, host_col), "measures")
    hosts = staged(host_verdicts(rows, host_limit).filter("not host_ok").select(F.col("host").alias("h")), "bad_hosts")
    failed = functools.reduce(operator.or_, base_rules().values())
    held = as_rows(docs).withColumn("m", measures(f"row.{text_col}")).select("row", F.col(f"row.{host_col}").alias("host"), "m.*").filter(~failed)
    return held.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left_anti").select("row.*")
