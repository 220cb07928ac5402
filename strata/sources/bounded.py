"""Files of any size in fixed buffers: lines too long to read, and SHA-256 sums.

Spark's text reader holds a line and its binary reader a file. What does not fit is read here: files are cut in byte ranges,
which are rows that Spark deals to tasks, and a task streams its range through one buffer. A line belongs to the range that it
begins in; a range inside of a longer line has none. Only files of over the bound are looked through for long lines, and only those
that have some are read in Python; all others stay with Spark's reader. Its lists of files leave empty ones out.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.store import staged
from strata.sources.transcripts import MOST_BYTES, files
from strata.sources.transcripts import read_lines as transcripts_lines

BUFFER, LEAST, RANGE = 1 << 20, 4 << 10, 128 << 20
LINES = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("bytes", T.LongType())])
SUMS = T.StructType([T.StructField("file", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType())])


def opened(uri: str):
    """A readable file of any file system that Arrow knows; a path alone is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def buffers(source, begin: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) from `begin` to the file's end. A first read goes no further than `end`; what a caller then needs is the rest of a
    line, so reads begin small there and double."""
    source.seek(begin)
    most = LEAST
    while data := source.read(min(BUFFER, end - begin if begin < end else most)):
        most = most if begin < end else 2 * most
        yield begin, np.frombuffer(data, np.uint8)
        begin += len(data)


def long_in_range(source, begin: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, bytes) of lines of over `most` bytes that start in [begin, end), their line ends aside."""
    start = 0 if begin == 0 else None  # a line that began before is another range's
    at = begin
    for at, data in buffers(source, max(begin - 1, 0), end):
        ends = np.flatnonzero(data == 10) + at
        at += len(data)
        starts = np.concatenate([ends[:0] if start is None else [start], ends + 1]).astype(np.int64)
        sizes = ends[len(ends) + 1 - len(starts) :] - starts[:-1]
        yield from ((int(s), int(n)) for s, n in zip(starts, sizes) if n > most and s < end)
        start = int(starts[-1]) if len(starts) else None
        if at >= end and (start is None or start >= end):
            return
    if start is not None and most < at - start and start < end:
        yield start, at - start


def short_in_range(source, begin: int, end: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(start, line) of lines of at most `most` bytes that start in [begin, end). What a buffer cuts off is held up to `most` bytes."""
    start, held = (0 if begin == 0 else None), b""  # held is None once the line is too long
    for at, data in buffers(source, max(begin - 1, 0), end):
        raw, done = data.tobytes(), 0
        for k in np.flatnonzero(data == 10).tolist():
            if start is not None and held is not None and len(held) + k - done <= most:
                yield start, held + raw[done:k]
            start, held, done = at + k + 1, b"", k + 1
            if start >= end:
                return
        if start is None and at + len(raw) >= end:
            return
        if start is not None:
            held = held + raw[done:] if held is not None and len(held) + len(raw) - done <= most else None
    if start is not None and held:
        yield start, held


def _in_ranges(read, most: int, names: list[str], kinds: list[pa.DataType], size: int = 4096):
    """Rows (file, what `read` finds in a range) of ranges (file, begin, end). A file stays open from one of its ranges to the next, and
    ranges share batches of rows."""
    schema = pa.schema([("file", pa.string()), *zip(names, kinds)])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        with contextlib.ExitStack() as held:
            at, source = None, None
            for batch in batches:
                for file, begin, end in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "end"))):
                    if file != at:
                        held.close()
                        at, source = file, held.enter_context(opened(file))
                    for row in read(source, begin, end, most):
                        yield file, *row

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), schema.types)], schema=schema)
        for row in found(batches):
            some.append(row)
            held += len(row[2]) if isinstance(row[2], bytes) else 0
            if len(some) == size or held > 4 * BUFFER:
                yield packed()
                some, held = [], 0
        if some:
            yield packed()
    return rows


def ranges(found: DataFrame, part: int = RANGE) -> DataFrame:
    """file, begin, end of the byte ranges of files (file, size), dealt to tasks; a task has those of a file one after the other."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(part).cast("long"))
    cut = found.filter("size > 0").select("file", F.explode(starts).alias("begin"))
    return cut.withColumn("end", F.col("begin") + part).repartition("file", "begin").sortWithinPartitions("file", "begin")


def long_lines(found: DataFrame, most_bytes: int = MOST_BYTES, part: int = RANGE) -> DataFrame:
    """file, start, bytes of the lines of files (file, size) that have over `most_bytes` bytes. Files that are no larger are not opened."""
    reader = _in_ranges(long_in_range, most_bytes, ["start", "bytes"], [pa.int64(), pa.int64()])
    return ranges(found.filter(F.col("size") > most_bytes), part).mapInArrow(reader, LINES)


def read_lines(spark: SparkSession, names: list[str], most_bytes: int = MOST_BYTES, part: int = RANGE, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Lines (file, seq, value) of at most `most_bytes` bytes of these files, and the places (file, start, bytes) of the longer ones.
    The files come as a list, as to Spark's own reader; those with a long line are a few of them."""
    found = files(spark, names, pattern)
    long = staged(long_lines(found, most_bytes, part), "long_lines")
    torn = {r.file for r in long.select("file").distinct().collect()}
    if not torn:
        return transcripts_lines(spark, names, pattern=pattern), long
    listed = found.select("file", "size")
    whole = [r.file for r in listed.select("file").collect() if r.file not in torn]
    reader = _in_ranges(short_in_range, most_bytes, ["start", "value"], [pa.int64(), pa.binary()])
    schema = T.StructType([LINES["file"], LINES["start"], T.StructField("value", T.BinaryType())])
    rows = ranges(listed.filter(F.col("file").isin(sorted(torn))), part).mapInArrow(reader, schema)
    text = F.regexp_replace(F.col("value").cast("string"), "\r$", "")
    short = rows.select("file", F.struct(F.col("start").alias("block"), F.lit(0).cast("long").alias("row")).alias("seq"), text.alias("value"))
    return (short if not whole else transcripts_lines(spark, whole, pattern=pattern).unionByName(short)), long


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("file").to_pylist():
            digest, size = hashlib.sha256(), 0
            try:
                with opened(file) as source:
                    while data := source.read(BUFFER):
                        digest.update(data)
                        size += len(data)
                told = size, digest.hexdigest()
            except OSError:  # the row says so
                told = None, None
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, *told), (pa.string(), pa.int64(), pa.string()))], ["file", "size", "sha256"])


def hashed_files(found: DataFrame) -> DataFrame:
    """file, size, sha256 of files (file), null where one cannot be read; a sum is one task's work, in one buffer, however large the
    file."""
    return found.select("file").repartition("file").mapInArrow(_sums, SUMS)


def verified_objects(spark: SparkSession, root: str) -> DataFrame:
    """file, size, sha256 of content-addressed objects whose name is their hash."""
    held = files(spark, f"{root.rstrip('/')}/raw/sha256", "*")
    named = F.regexp_extract("file", r"/([0-9a-f]{64})(?:\.[A-Za-z0-9]+)?$", 1)
    return hashed_files(held).filter(named == F.col("sha256"))
