"""Helpers that several training-data operators use: Arrow text access, word and rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.store import staged  # noqa: F401  (operators stage their tables through here)

#: The white space of all word and strip rules here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, and faster, on texts of ASCII alone."""
    plain = F.octet_length(column) == F.char_length(column)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (strings or bytes) one after another, and the n + 1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, most: int = 1 << 19):
    """Runs [i, j) of texts with about `most` bytes, at least one text each. Eight-byte arrays of a run stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cut_long(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The offsets with further cuts, and the text that each piece is of: texts of over `most` bytes are cut before white space
    at about every `most` bytes. A longer word stays whole."""
    cuts = [np.zeros(0, np.int64)]
    for k in np.flatnonzero(np.diff(offsets) > most).tolist():
        space = np.flatnonzero(_SPACE[data[offsets[k] : offsets[k + 1]]])
        at = np.searchsorted(space, np.arange(most, offsets[k + 1] - offsets[k], most))
        cuts.append(offsets[k] + np.unique(space[at[at < len(space)]]))
    inside = np.concatenate(cuts).astype(np.int64)
    pieces = np.ones(len(offsets) - 1, np.int64)
    np.add.at(pieces, np.searchsorted(offsets, inside, side="right") - 1, 1)
    return np.sort(np.concatenate([offsets, inside])), np.repeat(np.arange(len(pieces)), pieces)


def trim() -> None:
    """Give memory that a batch no longer needs back to the system; idle workers else hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def trimmed(batches):
    """The batches, with a trim after each is done with."""
    for batch in batches:
        yield batch
        del batch
        trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 20), np.uint64)
        filled = 1
        while filled < len(have):
            take = min(filled, len(have) - filled)
            have[filled : filled + take] = have[:take] * np.uint64(pow(base, filled, 1 << 64))
            filled += take
        _POWERS[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums of byte code * base ** position, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hashes of the spans [start, end): equal bytes give equal hashes anywhere."""
    inverse = powers(_BASE_INV, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's word offsets (n + 1). Words never cross texts."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = prefix_sums(data)
    return span_hash(sums, starts, ends), np.searchsorted(starts, offsets)


_STEP = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 8)]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of `size` words; entry i starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _STEP[k]
    return mix(out)


def longs(*names: str) -> T.StructType:
    """A struct of longs; a built type, since workers import modules without a session."""
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def as_rows(docs: DataFrame) -> DataFrame:
    """`docs` as one struct column `row`, so that no name of ours can clash with one of its columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def ranked(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with `rank`, from 0 in order of the columns. Rows are ranked by range partitions, so that no task
    holds them all; the driver sees one count for each partition."""
    held = staged(rows.repartitionByRange(*map(F.col, columns)).withColumn("pid", F.spark_partition_id()), "ranged")
    counts = {r["pid"]: r["n"] for r in held.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, seen = [F.lit(-1), F.lit(0).cast("long")], 0
    for pid in sorted(counts):
        before += [F.lit(pid), F.lit(seen).cast("long")]
        seen += counts[pid]
    place = F.row_number().over(Window.partitionBy("pid").orderBy(*columns)) - 1
    return held.withColumn("rank", place + F.create_map(*before)[F.col("pid")]).drop("pid")


def few(keys: DataFrame, most: int) -> DataFrame:
    """The keys of a written table, to be broadcast where they are at most `most`; else as they are."""
    return F.broadcast(keys) if keys.count() <= most else keys


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, zero: Column, join: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """Running results of `join` (associative, `zero` neutral) along an array: entry i has joined values 0 to i.

    A running list that grows by one copies itself at every step, so lists here grow inside blocks, and over
    blocks of blocks: of n values each is copied about `block` times.
    """
    def grown(xs: Column, first: Column) -> Column:
        """`first`, then the running results of `xs` from it."""
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def cut(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))

    def over(blocks: Column, befores: Column) -> Column:
        """Running results of all values of `blocks`, where `befores` has what stands before each block."""
        return F.flatten(F.zip_with(blocks, befores, lambda xs, b: let(grown(xs, b), lambda ys: F.slice(ys, F.lit(2), F.size(xs)))))

    def ahead(xs: Column) -> Column:
        """What stands before each of `xs`, in two levels of blocks."""
        total = lambda ys: F.aggregate(ys, zero, join)
        return let(cut(xs), lambda blocks: let(grown(F.transform(blocks, total), zero), lambda firsts: F.flatten(
            F.zip_with(blocks, F.slice(firsts, F.lit(1), F.size(blocks)), lambda ys, b: let(grown(ys, b), lambda zs: F.slice(zs, F.lit(1), F.size(ys)))))))

    total = lambda ys: F.aggregate(ys, zero, join)
    whole = lambda vs: let(grown(vs, zero), lambda ys: F.slice(ys, F.lit(2), F.size(vs)))
    blocked = lambda vs: let(cut(vs), lambda blocks: let(ahead(F.transform(blocks, total)), lambda befores: over(blocks, befores)))
    return let(values, lambda vs: F.when(F.size(vs) <= block, whole(vs)).otherwise(blocked(vs)))
