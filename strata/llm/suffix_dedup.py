"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Sorting every suffix would move several times the input for each pass, so the first digit is taken where it
can be found again in any copy: the least hash of the `gram`-byte strings (half of the window) inside each
window. A window and its copies choose the same place, an anchor, at the same offset. The passes go from
the most significant digit down and keep a group only while it has two members:

1. anchors by their gram: a gram met once ends all windows around it;
2. anchors by the whole stretch of their windows: equal stretches are repeated as they are;
3. the rest by ever narrower cells of offsets (32, 8, then 1). A cell whose windows' common core is met
   once is dropped, one whose stretch is met twice is repeated, others go to the next pass. In the last
   pass a cell is one window, and equal groups are exactly the repeated windows.

Every group is only counted, with map-side combine, so a passage that a third of all rows share costs a
row for each task. Offsets are bytes of UTF-8; matches never cross documents.

Cases: null text counts as empty; texts shorter than the window lose nothing; rows repeated with id and text
are copies of each other; a null id is an id like any other; an empty table gives no rows; other columns
are ignored. Long texts are read in stretches, so a task holds a fixed share of one besides the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.shared import mix, parts, prefix_sums, span_hash, staged, text_or_empty, trimmed, utf8

WIDTHS = (32, 8, 1)
_LOW = np.uint64((1 << 24) - 1)
KEY = ["doc_id", "xx"]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[s : s + width] for every s where that fits."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    held = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    held[: len(x)] = x
    rows = held.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """text number, anchor (byte in its text), least and greatest offset of the windows that choose it,
    hash of its gram, hash of the whole stretch of those windows."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64))
    if len(data) < window:
        return none
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    least = sliding_min((hashes & ~_LOW) | (at.astype(np.uint64) & _LOW), window - gram + 1)
    lengths = np.diff(offsets)
    last = np.repeat(offsets[1:] - window, lengths)[: len(least)]  # of each byte's text, the last window
    starts = np.flatnonzero(np.arange(len(least)) <= last)
    if not len(starts):
        return none
    chosen = starts + ((least[starts] - starts.astype(np.uint64)) & _LOW).astype(np.int64)
    # Windows of one text that choose one anchor are neighbours, as the choice never moves back.
    text = np.searchsorted(offsets, starts, side="right") - 1
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    end = np.r_[new[1:], len(starts)] - 1
    q, t, first, final = chosen[new], text[new], starts[new], starts[end]
    low, high = q - final, q - first
    stretch = mix(span_hash(sums, first, final + window) + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + high.astype(np.uint64))
    return t, (q - offsets[t]).astype(np.int32), low.astype(np.int32), high.astype(np.int32), hashes[q].view(np.int64), stretch.view(np.int64)


def stretches(offsets: np.ndarray, window: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(text, first, end) of runs of bytes: whole texts together, or stretches of a long one that overlap by a window
    less a byte, so that each window is whole in just one. -1 for a run of several texts: first and end are texts."""
    for i, j in parts(offsets, most):
        size = int(offsets[j] - offsets[i])
        if j - i > 1 or size <= 2 * most:
            yield -1, i, j
        else:
            for a in range(0, size - window + 1, most):
                yield i, a, min(a + most + window - 1, size)


def _anchor_rows(window: int, gram: int, most: int = 1 << 19):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column("text"))
            for text, a, b in stretches(offsets, window, most):
                if text < 0:
                    t, q, *rest = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, gram)
                    at = pa.array(t + a)
                else:
                    t, q, *rest = anchors(data[offsets[text] + a : offsets[text] + b], np.array([0, b - a]), window, gram)
                    q, at = q + np.int32(a), pa.array(np.full(len(t), text))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("xx").take(at), *map(pa.array, (q, *rest))], ["doc_id", "xx", "q", "low", "high", "gram", "outer"])
    return rows


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans as maximal runs."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return list(zip(s[new].tolist(), e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]].tolist()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        data, offsets = utf8(batch.column("text"))
        held = memoryview(np.ascontiguousarray(data))
        lists = batch.column("spans")
        at = lists.offsets.to_numpy()
        spans = lists.values
        starts, ends = (spans.field(k).to_numpy() for k in (0, 1)) if len(spans) else (np.zeros(0, np.int32),) * 2
        n_removed, n_spans, kept = [], [], []
        for i in range(batch.num_rows):
            text = held[offsets[i] : offsets[i + 1]]
            a, b = int(at[i]), int(at[i + 1])
            runs = covered(starts[a:b], ends[a:b]) if b > a and lists.is_valid()[i].as_py() else []
            pieces, done = [], 0
            for s, e in runs:
                pieces.append(text[done:s])
                done = e
            pieces.append(text[done:])
            n_spans.append(len(runs))
            n_removed.append(sum(e - s for s, e in runs))
            kept.append(b"".join(pieces))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
             pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()), pa.array([x.decode(errors="ignore") for x in kept], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])


def split_cells(cells: DataFrame, width: int, window: int) -> DataFrame:
    """Cells (.., low, high, content) cut at multiples of `width` offsets, with their outer and inner keys."""
    parts_ = cells.withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, high div {width})")))
    parts_ = parts_.withColumn("lo", F.greatest("low", (F.col("cell") * width).cast("int"))).withColumn("hi", F.least("high", (F.col("cell") * width + width - 1).cast("int")))
    content = F.expr(f"substring(content, high - hi + 1, hi - lo + {window})")
    core = F.expr(f"substring(content, cast(high - cell * {width} + 1 as int), {window - width + 1})")
    return parts_.select(
        *KEY, "q", "need", "gram", "cell", F.col("lo").alias("low"), F.col("hi").alias("high"), content.alias("content"),
        F.xxhash64(content, "lo", "hi").alias("outer"), F.xxhash64(core, "cell").alias("inner"))


def repeated_spans(docs: DataFrame, window: int = 400, gram: int | None = None, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """doc_id, xx, start, end: byte spans made of repeated windows, of `docs` (doc_id, xx, text)."""
    gram = gram or window // 2
    fields = [docs.schema["doc_id"], T.StructField("xx", T.LongType())]
    fields += [T.StructField(n, T.IntegerType()) for n in ("q", "low", "high")] + [T.StructField(n, T.LongType()) for n in ("gram", "outer")]
    found = staged(docs.mapInArrow(_anchor_rows(window, gram), T.StructType(fields)), "anchors")
    # Whatever meets the rows of a hot gram is staged first: its join can then be split by adaptive execution.
    shared = staged(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "grams")
    held = staged(found.join(shared, "gram"), "shared_anchors")
    twice = staged(held.groupBy("gram", "outer").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "outer", F.lit(True).alias("twice")), "stretches")
    told = staged(held.join(twice, ["gram", "outer"], "left"), "told_anchors")
    span = [*KEY, (F.col("q") - F.col("high")).alias("start"), (F.col("q") - F.col("low") + window).alias("end")]
    spans = [told.filter("twice").select(*span)]
    open_ = told.filter("twice is null")
    # One member of each settled stretch goes on as a partner, where its gram has open anchors.
    partners = told.filter("twice").dropDuplicates(["gram", "outer"]).join(staged(open_.select("gram").distinct(), "open_grams"), "gram", "left_semi")
    columns = [*KEY, "q", "low", "high", "gram"]
    going = staged(open_.select(*columns, F.lit(True).alias("need")).unionByName(partners.select(*columns, F.lit(False).alias("need"))), "open_anchors")
    texts = docs.withColumnsRenamed({"doc_id": "d", "xx": "x"})
    at = texts.hint("merge").join(going, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xx") == F.col("x")))
    content = F.expr(f"substring(cast(text as binary), q - high + 1, high - low + {window})")
    cells = staged(at.select(*KEY, "q", "low", "high", "gram", "need", content.alias("content")).distinct(), "contents")
    for width in widths:
        cut = split_cells(cells, width, window)
        # Bytes are read off only for a further pass.
        cut = staged(cut.drop("content") if width == widths[-1] else cut, f"cells_{width}")
        outer = staged(cut.groupBy("gram", "outer").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "outer", F.lit(True).alias("twice")), f"outer_{width}")
        inner = staged(cut.groupBy("gram", "inner").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "inner"), f"inner_{width}")
        met = staged(cut.join(inner, ["gram", "inner"], "left_semi").join(outer, ["gram", "outer"], "left"), f"met_{width}")
        spans.append(met.filter("twice and need").select(*span))
        if width == widths[-1]:
            break
        rest = met.filter("twice is null")
        rep = met.filter("twice").dropDuplicates(["gram", "outer"]).withColumn("need", F.lit(False))
        rep = rep.join(staged(rest.select("gram", "inner").distinct(), f"open_{width}"), ["gram", "inner"], "left_semi")
        cells = rest.unionByName(rep.select(*rest.columns)).select(*KEY, "q", "low", "high", "gram", "need", "content")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int | None = None, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), and kept_text, the
    same as text without what a cut left of a character."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("xx"), "text")
    spans = repeated_spans(base, window, gram, widths)
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "d", "xx": "x"})
    met = base.hint("merge").join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xx") == F.col("x")), "left").select("doc_id", "text", "spans")
    fields = [base.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    return met.mapInArrow(_cut, T.StructType([*fields, T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())]))
