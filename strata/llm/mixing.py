"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source has a target in words. A source's documents are dealt by a seeded hash to shards of about
`shard_words` words, so that a hot source is many groups. The mix is allotted in blocks of `block_words`
words: shard quotas are the highest quotients target / (2 q + 1) over all shards of all sources. The
common divisor that gives all blocks is found with grouped sums (only scalars reach the driver); ties at
the last block go to the first source and shard. A shard's documents stand in a seeded order as a
circle of blocks, and a quota takes whole rounds of it and then blocks from a seeded one on.

Rows of one id, text (by a 64-bit hash, not compared further) and source are counted first and dealt in pieces, so no shard
holds all rows of a hot or null id.

Cases: null text has no words and is never taken; a null source is the last source; a null id
is placed by its text; rows of one id, text and source share what their pieces take; an
empty table, or one without words, takes nothing; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.shared import as_rows, ranked, staged, text_or_empty, word_count

#: Fixed values of the mix: weights of the sources in order, and the mix's size over that of its input.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
KEY = ["skey", "snull"]


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """skey, snull, source_size, target; `sized` holds skey, snull and size."""
    sums = sized.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    if sums.isEmpty():
        return sums.withColumn("target", F.lit(0.0))
    parts, rank = ranked(sums, "snull", "skey"), F.col("rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    held = staged(parts.select(*KEY, "source_size", weight.alias("weight")), "weighted")
    most = MOST_REPEATS * F.col("source_size")
    want, c, was = None, 0.0, -1.0
    while c != was:
        was = c
        full = most < F.col("weight") * F.lit(c)
        got = held.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, most).otherwise(0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        want = share * (got["total"] or 0)
        c = (want - got["capped"]) / got["open"] if got["open"] else c
    return held.select(*KEY, "source_size", F.least(most.cast("double"), F.col("weight") * F.lit(c)).alias("target"))


def seats(target: Column, cap: Column, divisor: float) -> Column:
    return F.least(cap, F.floor(target / F.lit(divisor) + 0.5))


def apportion(cells: DataFrame, block_words: int) -> DataFrame:
    """Adds `quota`, whole blocks, to cells (skey, snull, shard, words, target)."""
    cells = staged(cells.withColumn("cap", F.ceil(MOST_REPEATS * F.col("words") / block_words)), "cells")
    sums = cells.agg(F.sum("target").alias("target"), F.sum("cap").alias("cap")).first()
    blocks = min(round((sums["target"] or 0) / block_words), sums["cap"] or 0)
    if not blocks:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    low, high, steps = block_words / 4.0, block_words * 4.0, 16

    def counts(divisors: list[float]) -> list[int]:
        row = cells.agg(*[F.sum(seats(F.col("target"), F.col("cap"), d)).alias(f"s{i}") for i, d in enumerate(divisors)]).first()
        return [int(x) for x in row]

    while counts([low])[0] < blocks:
        low /= 64
    while counts([high])[0] > blocks:
        high *= 64
    exact = None
    while exact is None and high / low - 1 > 1e-13:
        ratio = (high / low) ** (1 / steps)
        tried = [low * ratio**i for i in range(1, steps)]
        got = counts(tried)
        exact = next((d for d, n in zip(tried, got) if n == blocks), None)
        low = max([low, *(d for d, n in zip(tried, got) if n > blocks)])
        high = min([high, *(d for d, n in zip(tried, got) if n < blocks)])
    if exact is not None:
        return cells.withColumn("quota", seats(F.col("target"), F.col("cap"), exact))
    seated = cells.withColumn("quota", seats(F.col("target"), F.col("cap"), high))
    left = blocks - counts([high])[0]
    tied = seated.filter("quota < cap").orderBy((F.col("target") / (2 * F.col("quota") + 1)).desc(), "snull", "skey", "shard").limit(left)
    return seated.join(tied.select(*KEY, "shard", F.lit(1).alias("more")), [*KEY, "shard"], "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop("more")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
           block_words: int = 16, shard_words: int = 50_000, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, xx (hash of its text), source, size, rows, piece, source_size, target, shard, quota (its shard's), taken (by all rows
    together). Rows of one id, text and source are counted, not moved, and stand in pieces of about a shard's words each."""
    kinds = staged(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("xx"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"),
        F.coalesce(F.col(source_col), F.lit("")).alias("skey"), F.col(source_col).isNull().alias("snull"))
        .groupBy("doc_id", "xx", "source", "size", *KEY).agg(F.count(F.lit(1)).alias("rows")), "sized")
    targets = staged(source_targets(kinds.select(*KEY, (F.col("size") * F.col("rows")).alias("size")), weights, share), "targets")
    each = F.greatest(F.lit(1), F.floor(F.lit(shard_words) / F.greatest("size", F.lit(1))))
    dealt = kinds.withColumn("each", each).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / F.col("each")))))
    dealt = dealt.withColumn("rows", F.least("each", F.col("rows") - F.col("piece") * F.col("each"))).drop("each")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    placed = dealt.join(targets, KEY).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "xx", "piece"), shards)).withColumn("order", F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "xx", "piece"))
    placed = staged(placed, "placed")
    cells = placed.groupBy(*KEY, "shard").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.first("target").alias("t"), F.first("source_size").alias("s"))
    cells = cells.select(*KEY, "shard", "words", F.when(F.col("s") > 0, F.col("t") * F.col("words") / F.col("s")).otherwise(0.0).alias("target"))
    quotas = staged(apportion(cells, block_words).select(*KEY, "shard", "words", "quota"), "quotas")
    # Texts without words take nothing, however many they are: they stay out of the windows.
    in_shard = Window.partitionBy(*KEY, "shard").orderBy("order", "doc_id", "size", "xx", "piece").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("size") * F.col("rows")
    met = placed.filter("size > 0").withColumn("begin", F.sum(own).over(in_shard) - own).join(quotas, [*KEY, "shard"])
    words, begin = F.col("words"), F.col("begin")
    whole = F.least(F.col("quota") * block_words, MOST_REPEATS * words)
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "skey", "snull", "shard"), F.greatest(F.lit(1), F.ceil(words / block_words))) * block_words
    met = met.withColumn("rounds", F.floor(whole / words)).withColumn("first", start).withColumn("last", start + whole - F.col("rounds") * words)

    def shared(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(begin + own, b) - F.greatest(begin, a))

    part = shared(F.col("first"), F.col("last")) + shared(F.lit(0), F.col("last") - words)
    met = met.withColumn("taken", F.col("rounds") * own + part)
    none = placed.filter("size = 0").join(quotas, [*KEY, "shard"]).withColumn("taken", F.lit(0))
    columns = ["doc_id", "xx", "source", "size", "rows", "piece", "source_size", "target", *KEY, "shard"]
    rows = [x.select(*columns, F.col("quota").cast("long").alias("quota"), F.col("taken").cast("long").alias("taken")) for x in (met, none)]
    return rows[0].unionByName(rows[1])


def mix(docs: DataFrame, *columns: str, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, xx (hash of its text), source, size, source_size, target, quota (its shard's),
    taken. Rows of a piece share its words out as evenly as whole words allow. Arguments are those of `pieces`."""
    rows = pieces(docs, *columns, **options).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    upto = lambda j: F.floor(j * F.col("taken") / F.col("rows"))
    return rows.select("doc_id", "xx", "source", "size", "source_size", "target", "quota", (upto(F.col("j")) - upto(F.col("j") - 1)).cast("long").alias("taken"))


def copies(size: np.ndarray, rows: np.ndarray, taken: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whole copies of a shard's pieces that hold about the words taken: all that fit, then, largest first, what still
    fits, pieces that were taken in part before others; at last one more, and what fits of the words too many taken out again,
    where that comes nearer."""
    held = taken // size
    left = int(taken.sum() - (held * size).sum())
    ranks = np.lexsort((order, -size, taken % size == 0))
    for i in ranks:
        more = min(left // size[i], MOST_REPEATS * rows[i] - held[i])
        held[i] += more
        left -= more * size[i]
    free = ranks[(held < MOST_REPEATS * rows)[ranks]]
    if left and len(free):
        other, last = held.copy(), free[np.argmin(size[free])]
        other[last] += 1
        over = size[last] - left
        for i in np.lexsort((order, -size)):
            less = min(over // size[i], other[i]) if i != last else 0
            other[i] -= less
            over -= less * size[i]
        held = other if over < left else held
    return held


def _copies(group: pa.Table) -> pa.Table:
    size, rows, taken, order = (group.column(c).to_numpy() for c in ("size", "rows", "taken", "order"))
    return group.select(["doc_id", "xx", "source", "rows"]).append_column("copies", pa.array(copies(size, rows, taken, order), pa.int64()))


def keep_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs` as the mix holds them, columns unchanged, each row a whole number of times. What whole rows leave of a shard's
    words goes to other rows of it, so that a source's words stay near its target; a shard is one task's group, of
    about `shard_words` words. Rows that share id, text and source share their copies out evenly."""
    dealt = pieces(docs, id_col, text_col, source_col, **options).filter("size > 0")
    dealt = dealt.select(*KEY, "shard", "doc_id", "xx", "source", "size", "rows", "taken", F.xxhash64("doc_id", "xx", "piece").alias("order"))
    fields = T.StructType([*[dealt.schema[c] for c in ("doc_id", "xx", "source")], T.StructField("rows", T.LongType()), T.StructField("copies", T.LongType())])
    whole = dealt.groupBy(*KEY, "shard").applyInArrow(_copies, fields)
    wanted = whole.groupBy(F.col("doc_id").alias("d"), F.col("xx").alias("x"), F.col("source").alias("s")).agg(F.sum("copies").alias("copies"), F.sum("rows").alias("rows"))
    wanted = staged(wanted.filter("copies > 0"), "copies")
    name = lambda c: F.col(f"row.{c}")
    held = as_rows(docs).withColumn("w", F.xxhash64(text_or_empty(f"row.{text_col}"))).hint("merge")
    met = held.join(wanted, name(id_col).eqNullSafe(F.col("d")) & (F.col("w") == F.col("x")) & name(source_col).eqNullSafe(F.col("s")))
    out = met.filter("rows = 1").select("row", F.col("copies").alias("times"))
    if not wanted.filter("rows > 1").isEmpty():
        # Repeated rows are numbered part by part: counts of the parts come first, so that no task meets all rows of a key.
        many = staged(met.filter("rows > 1").withColumn("part", F.spark_partition_id()), "repeated")
        key = ["d", "x", "s", "part"]
        parts = many.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("d", "x", "s").orderBy("part")) - F.col("n")
        parts = staged(parts.select(*[F.col(c).alias(f"_{c}") for c in key], ahead.alias("ahead")), "parts")
        placed = many.join(parts, functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]))
        place = F.col("ahead") + F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
        times = F.floor(F.col("copies") / F.col("rows")) + (place <= F.col("copies") % F.col("rows")).cast("long")
        out = out.unionByName(placed.select("row", times.alias("times")).filter("times > 0"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
