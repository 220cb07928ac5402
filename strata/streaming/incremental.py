"""Incremental refresh of the catalog, in batches or with Structured Streaming.

The file source lists each new transcript once; a file that grew is found by the ledger of sizes and times and
comes again in full. A batch replaces all rows of its sessions, so a batch that runs twice changes
nothing, and owners of shared messages are recomputed for the sessions that the batch touched. All tables of a batch and its
rows of the ledger appear together, so a run that breaks off goes on with the batch that it was at.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import catalog, records, sinks
from strata.operators.paths import session_paths
from strata.sources import bounded, managed
from strata.sources.store import Store, staged
from strata.sources.transcripts import MOST_BYTES, changed_files, files, first_stem, holds_marker, parsed_lines, transcripts_only

#: Columns of the binary file source; the content is never read.
BINARY = "path string, modificationTime timestamp, length long, content binary"
KEYED = ("tool_calls", "session_paths", "session_daily_usage", "turns")


def derive(good: DataFrame, dialect: str) -> dict[str, DataFrame]:
    """Session tables of staged records (file, seq, v)."""
    tables = {"claudecode": records.claude, "codex": records.codex}[dialect](good)
    out = {k: tables[k] for k in ("sessions", "turns")}
    calls = tables["tool_calls"]
    out["tool_calls"] = calls.select("session_id", "seq", "tool_name", "command", "timestamp", "operation", "is_error")
    out["session_paths"] = sinks.aggregate_paths(session_paths(calls))
    out["session_daily_usage"] = records.daily(tables)
    out["message_claims"] = tables.get("claims")
    return out


def read_once(lines: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """file, seq, v, reject, marked, h1, h2 of every line that is not blank, written: what a batch needs of its lines from one reading."""
    hashes = [F.xxhash64(F.lit(k), "value").alias(f"h{k}") for k in (1, 2)]
    return staged(parsed_lines(lines.withColumn("more", F.struct(holds_marker(markers).alias("marked"), *hashes)), keep=("more",)).select("file", "seq", "v", "reject", "more.*"), "lines")


def file_hashes(held: DataFrame) -> DataFrame:
    """file, file_hash: two sums of hashes over the file's lines. It tells that lines came or changed, however large the
    file; no task reads a file as a whole."""
    sums = [F.sum(F.col(f"h{k}").cast("decimal(38,0)")) for k in (1, 2)]
    return held.groupBy("file").agg(F.concat_ws(":", F.count(F.lit(1)), *[s.cast("string") for s in sums]).alias("file_hash"))


def ingest(spark: SparkSession, names: list[str], dialect: str, store: Store, markers: tuple[str, ...], most_bytes: int = MOST_BYTES, copies: dict[str, str] | None = None) -> None:
    """Write the sessions of files, but for files with a privacy marker: those go to the table `private_files`,
    and of a session that is already held from one the turns are dropped. A file of `copies` is read from there and keeps its name."""
    copies = copies or {}
    short, long = bounded.read_lines(spark, [copies.get(n, n) for n in names], most_bytes)
    if copies:
        of = spark.createDataFrame([(c, n) for n, c in copies.items()], "_copy string, _name string")
        short, long = (x.join(of, F.col("file") == F.col("_copy"), "left").withColumn("file", F.coalesce("_name", "file")).drop("_copy", "_name") for x in (short, long))
    lines = read_once(short, markers)
    batch = spark.createDataFrame([(n,) for n in names], "file string")
    private = staged(lines.filter("marked").select("file").distinct(), "private_files")
    good = lines.filter("reject is null").select("file", "seq", "v")
    marked = not private.isEmpty()
    tables = derive(good.join(private, "file", "left_anti") if marked else good, dialect)
    tables["sessions"] = staged(tables["sessions"], "sessions")
    touched = staged(tables["sessions"].select("session_id"), "touched")
    keys = None
    if tables["message_claims"] is not None or store.version("message_claims"):
        held = store.read("message_claims", tables["sessions"].select("session_id", F.lit("").alias("claim_key")).schema)
        keys = staged(held.join(touched, "session_id", "left_semi").select("claim_key").distinct(), "claim_keys")
    with store.batch():
        for name in ("sessions", *KEYED, "message_claims"):
            if tables.get(name) is not None:
                store.replace(name, tables[name], touched)
        store.replace("file_hashes", file_hashes(lines), batch, "file")
        store.replace("long_lines", long, batch, "file")
        if marked or store.version("private_files"):
            store.replace("private_files", private, batch, "file")
        if marked:
            hidden = store.read("sessions").join(private, "file", "left_semi").select("session_id")
            store.replace("turns", store.read("turns").limit(0), staged(hidden, "hidden"))
        if keys is not None and store.version("message_claims"):
            refresh_native(store, touched, keys)


def refresh_native(store: Store, touched: DataFrame, before: DataFrame) -> None:
    """Usage that counts each message once, anew for the touched sessions and for all that hold a claim which those held
    `before` (claim_key) or hold now. Only claims of these sessions, and those on the same keys, are summed."""
    measures = records.MEASURES[:8]
    claims = store.read("message_claims")
    now = claims.join(touched, "session_id", "left_semi").select("claim_key")
    keys = staged(before.unionByName(now).distinct(), "claim_keys")
    affected = staged(claims.join(keys, "claim_key", "left_semi").select("session_id").unionByName(touched).distinct(), "affected")
    own = claims.join(affected, "session_id", "left_semi")
    rivals = staged(claims.join(own.select("claim_key").distinct(), "claim_key", "left_semi"), "claims")
    sessions = store.read("sessions").withColumn("uses_claims", F.col("source") == "claudecode")
    known = sessions.join(rivals.select("session_id").unionByName(affected).distinct(), "session_id", "left_semi")
    store.replace("native_usage", catalog.native_usage(rivals, known, measures).join(affected, "session_id", "left_semi"), affected)


#: Version of the derivation from transcripts; a file that an older one read is read again, whether or not it changed.
PARSED = 1


def refresh(spark: SparkSession, found: DataFrame, store: Store, markers: tuple[str, ...], batch: int, rotated: bool = False) -> int:
    """Ingest the new and changed of `found` (file, size, modified, dialect, priority) and those that an older version read, `batch`
    files at a time; of files with one stem, those of earlier batches included, the first counts. With `rotated`, `found` is all there is:
    files of the ledger that are gone and of an older version are read from their managed copies, or wait as rows of
    `retries`. Tells how many files were read."""
    ledger = store.read("ledger", T.StructType([*found.schema.fields, T.StructField("parsed", T.IntegerType())]))
    known = ledger.select(*found.columns).join(found.select("file"), "file", "left_anti").withColumn("_new", F.lit(False))
    first = first_stem(found.withColumn("_new", F.lit(True)).unionByName(known))
    current = ledger.filter(F.coalesce("parsed", F.lit(0)) >= PARSED)
    changed = staged(changed_files(first.filter("_new").drop("_new"), current).withColumn("path", F.col("file")), "changed_files")
    old = ledger.filter(F.coalesce("parsed", F.lit(0)) < PARSED).join(first.filter("not _new").select("file"), "file", "left_semi")
    if rotated and not old.isEmpty():
        due = staged(old.select(*found.columns), "due")
        readable, failed = managed.resolve(due, found, store.read("copies", managed.COPY))
        readable, failed = staged(readable, "readable"), staged(failed, "failed")
        store.replace("retries", managed.retried(store.read("retries", managed.RETRY), due, failed).join(due.select("file"), "file", "left_semi"), due, "file")
        changed = changed.select(*found.columns, "path").unionByName(due.join(readable.select("file", "path"), "file"))
    count = changed.count()
    for dialect in sorted(r[0] for r in changed.select("dialect").distinct().collect()):
        names = changed.filter(F.col("dialect") == dialect).select("file", "path").toLocalIterator()
        while part := list(itertools.islice(names, batch)):
            with store.batch():
                copies = {r.file: r.path for r in part if r.path != r.file}
                ingest(spark, [r.file for r in part], "codex" if dialect.startswith("codex") else dialect, store, markers, copies=copies)
                done = spark.createDataFrame([(r.file,) for r in part], "file string")
                rows = changed.join(done, "file", "left_semi").select(*found.columns, F.lit(PARSED).alias("parsed"))
                store.replace("ledger", rows, done, "file")
                if store.version("retries"):  # what was read no longer waits
                    store.replace("retries", store.read("retries").limit(0), done, "file")
    return count


def sync(spark: SparkSession, folders: list[tuple[str, str, int]], store: Store, ignore: tuple[str, ...] = (), markers: tuple[str, ...] = (), batch: int = 10_000) -> int:
    """Ingest new and changed transcripts of (folder, dialect, priority); tells how many files it read."""
    found = None
    for folder, dialect, priority in folders:
        part = files(spark, folder).withColumns({"dialect": F.lit(dialect), "priority": F.lit(priority)})
        found = part if found is None else found.unionByName(part)
    return refresh(spark, staged(transcripts_only(found, ignore), "found_files"), store, markers, batch, rotated=True)


def stream(spark: SparkSession, folder: str, dialect: str, store: Store, checkpoint: str, files_per_batch: int = 200, ignore: tuple[str, ...] = (), markers: tuple[str, ...] = (), priority: int = 0, after: Callable[[int], None] | None = None):
    """A streaming query that ingests new files of a folder, by the same ledger as `sync`, and stops when none is left. The source lists
    files without reading them; `after` is called with the number of files read of each batch that read some."""
    source = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).load(folder)
    listed = source.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def batch(rows: DataFrame, number: int) -> None:
        found = transcripts_only(rows, ignore).distinct().withColumns({"dialect": F.lit(dialect), "priority": F.lit(priority)})
        count = refresh(rows.sparkSession, staged(found, "found_files"), store, markers, files_per_batch)
        if count and after:
            after(count)

    return listed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
