"""Exact deduplication by composable polynomial fingerprints.

A text is cut in chunks of CHUNK bytes; each chunk is hashed by itself, modulo two primes, and hashes
combine by H(AB) = H(A) + base ** |A| * H(B). Texts above `huge_bytes` are cut in segments that
different tasks hash; the segments combine by the same rule. Texts of equal fingerprint (length and
both hashes) are then compared chunk by chunk: a chunk row per group, position and content, counted
with map-side combine, so that a group of any size is read as a stream and never gathered. Chunks and
segments are slices of the text's bytes, cut in one walk, so time follows the length of a text.

Cases: null text counts as empty; an empty text is a text; a null id loses against any other; of rows
repeated with id and text exactly one stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.shared import as_rows, few, longs, parts, staged, text_or_empty, trim, trimmed, utf8

#: Primes below 2 ** 31 and bases; a product of two residues fits 62 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253 % 2147483629)
CHUNK = 4096
FP = longs("n", "h1", "h2", "p1", "p2")
KEY = ["n", "h1", "h2"]


def _chunk_weights(base: int, prime: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.int64), 1
    for i in range(n):
        out[i], x = x, x * base % prime
    return out


_WEIGHTS = [_chunk_weights(b, p, CHUNK) for b, p in zip(BASES, PRIMES)]
_SHIFTS: list[np.ndarray] = [np.ones(1, np.int64), np.ones(1, np.int64)]


def _shifts(k: int, n: int) -> np.ndarray:
    """base ** (CHUNK * i) for i below n."""
    if len(_SHIFTS[k]) < n:
        _SHIFTS[k] = _chunk_weights(pow(BASES[k], CHUNK, PRIMES[k]), PRIMES[k], n)
    return _SHIFTS[k]


def fingerprint_bytes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n, h1, h2 and the shift factors base ** n of each text."""
    lengths = np.diff(offsets)
    chunks = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])
    owner = np.repeat(np.arange(len(lengths)), chunks)
    order = np.arange(first[-1]) - first[owner]
    starts = offsets[:-1][owner] + order * CHUNK
    sizes = np.diff(np.append(starts, len(data)))
    inside = np.arange(len(data)) - np.repeat(starts, sizes)
    found = [lengths]
    for k, prime in enumerate(PRIMES):
        h = np.zeros(len(lengths), np.int64)
        if len(starts):
            each = np.add.reduceat(_WEIGHTS[k][inside] * data, starts) % prime
            shifted = each * _shifts(k, int(order.max()) + 1)[order] % prime
            full = chunks > 0
            h[full] = np.add.reduceat(shifted, first[:-1][full]) % prime
        found.append(h)
    for base, prime in zip(BASES, PRIMES):
        found.append(np.array([pow(base, int(n), prime) for n in lengths], np.int64))
    return found


@F.arrow_udf(FP)
def fingerprint(texts: pa.Array) -> pa.Array:
    data, offsets = utf8(texts)
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for i, j in parts(offsets):
        for held, x in zip(out, fingerprint_bytes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
            held.append(x)
    trim()
    names = ["n", "h1", "h2", "p1", "p2"]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names)


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of two texts one after the other."""
    h = [(a[f"h{k + 1}"] + b[f"h{k + 1}"] * a[f"p{k + 1}"] % p) % p for k, p in enumerate(PRIMES)]
    shift = [a[f"p{k + 1}"] * b[f"p{k + 1}"] % p for k, p in enumerate(PRIMES)]
    return F.struct((a["n"] + b["n"]).alias("n"), h[0].alias("h1"), h[1].alias("h2"), shift[0].alias("p1"), shift[1].alias("p2"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, huge_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, xx (64-bit text hash, only to tell rows of one id apart), n, h1, h2, text_sha256."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    row = base.withColumn("xx", F.xxhash64("text")).withColumn("text_sha256", F.sha2("text", 256))
    large = F.octet_length("text") > huge_bytes
    small = row.filter(~large).select("doc_id", "xx", "text_sha256", fingerprint("text").alias("fp"))
    names = ["doc_id", "xx", "text_sha256"]
    cut = row.filter(large).mapInArrow(_pieces(names, max(1, huge_bytes // 4)), T.StructType([*[row.schema[c] for c in names], *PIECE]))
    segments = cut.repartition("doc_id", "k").withColumnRenamed("piece", "text")
    hashed = segments.select("doc_id", "xx", "text_sha256", "k", fingerprint("text").alias("fp"))
    once = hashed.groupBy("doc_id", "xx", "text_sha256", "k", "fp").agg(F.count(F.lit(1)).alias("copies"))
    unit = F.expr(f"cast(named_struct('n', 0L, 'h1', 0L, 'h2', 0L, 'p1', 1L, 'p2', 1L) as {FP.simpleString()})")
    joined = once.groupBy("doc_id", "xx", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("k", "fp"))).alias("s"), F.max("copies").alias("copies"))
    long = joined.select("doc_id", "xx", "text_sha256", F.aggregate("s", unit, lambda a, x: combine(a, x["fp"]).cast(FP)).alias("fp"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")
    return small.unionByName(long).select("doc_id", "xx", "text_sha256", *[F.col("fp")[c].alias(c) for c in KEY])


def _pieces(names: list[str], size: int, most: int = 4 << 20):
    """Rows (names, k, piece) of the texts' pieces of `size` bytes: one walk over each text, with batches of about `most` bytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column("text"))
            counts = np.maximum(-(-np.diff(offsets) // size), 1)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = offsets[owner] + k * size
            end = np.minimum(start + size, offsets[owner + 1])
            step = max(1, most // size)
            for i in range(0, len(owner), step):
                s, e, at = start[i : i + step], end[i : i + step], pa.array(owner[i : i + step])
                # Pieces of neighbouring texts lie one after another.
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.r_[0, np.cumsum(e - s)].astype(np.int64)), pa.py_buffer(data[s[0] : e[-1]].tobytes())])
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in names], pa.array(k[i : i + step]), held.cast(pa.binary())], [*names, "k", "piece"])
    return rows


PIECE = [T.StructField("k", T.LongType()), T.StructField("piece", T.BinaryType())]


def unequal(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, few_ids: int = 1 << 18) -> DataFrame:
    """Fingerprints whose texts differ in some chunk; without a collision, none. Texts of group members alone
    are read for chunks: up to `few_ids` of them (some 100 bytes each) find their rows by a broadcast, more by a merge."""
    groups = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    members = staged(rows.select("doc_id", "xx", *KEY).join(groups, KEY).distinct(), "members")
    texts = docs.select(F.col(id_col).alias("d"), text_or_empty(text_col).alias("text")).withColumn("x", F.xxhash64("text"))
    held = texts.join(few(members, few_ids), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("xx")))
    chunks = held.select(*KEY, "text").mapInArrow(_pieces(KEY, CHUNK), T.StructType([*[rows.schema[c] for c in KEY], *PIECE]))
    return chunks.distinct().groupBy(*KEY, "k").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(*KEY).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays. Rows of a fingerprint that the comparison finds unequal are
    told apart by their SHA-256.
    """
    rows = staged(fingerprints(docs, id_col, text_col, huge_bytes), "fingerprints")
    split = unequal(docs, rows, id_col, text_col).withColumn("hit", F.lit(True))
    apart = staged(split, "unequal")
    side = F.when(F.col("hit"), F.col("text_sha256")).otherwise("")
    classed = rows.join(apart, KEY, "left").withColumn("side", side).drop("hit")
    key = [*KEY, "side"]
    classes = staged(classed.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "classes")
    counted = classed.groupBy(*key, "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    full = counted.join(classes, key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return full.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without all but one row of each group of equal texts, columns unchanged."""
    seen = exact_dedup(docs, id_col, text_col).groupBy(F.col("doc_id").alias("k"), F.col("text_sha256").alias("s")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    seen = staged(seen.filter("not kept or rows > 1"), "seen")
    told = as_rows(docs).select("row", F.col(f"row.{id_col}").alias("id"), F.sha2(text_or_empty(f"row.{text_col}"), 256).alias("t")).hint("merge")
    same = F.col("id").eqNullSafe(F.col("k")) & (F.col("t") == F.col("s"))
    repeated = seen.filter("kept").select("k", "s")
    out = told.join(seen.select("k", "s"), same, "left_anti")
    if not repeated.isEmpty():
        out = out.unionByName(told.join(repeated, same, "left_semi").dropDuplicates(["id", "t"]))
    return out.select("row.*")
