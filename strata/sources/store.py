"""Tables in folders that driver and executors share."""

from __future__ import annotations

import contextlib
import copy
import functools
import json
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new local folder only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and return the written table, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a new store holds.
EMPTY = {"number": 0, "tables": {}, "marks": {}}


class Store:
    """Catalog tables as Parquet folders that one manifest names.

    A batch writes new folders beside the old ones and then one small manifest, so readers see all of its tables or none, and a
    batch that breaks off leaves the state before it. A table replaced by key is merged on read: a batch appends a segment
    of its rows and one of the keys that they replace, so it writes as much as it holds, not as much as the table does. A
    table of more than `most` segments has its last ones merged, as many as are not much larger together than what follows
    them; each row is so written again a number of times that grows with the logarithm of the table. One writer at a time is the
    caller's to ensure.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 8, keep: int = 10):
        self.spark, self.root, self.most, self.keep = spark, root.rstrip("/"), most, keep
        self._draft: dict | None = None
        self._made: set[str] = set()  # folders of the open batch

    # Files, by whatever file system the root is on.

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _delete(self, path: str) -> None:
        fs, where = self._fs(f"{self.root}/{path}")
        fs.delete(where, True)

    def _size(self, path: str) -> int:
        fs, where = self._fs(f"{self.root}/{path}")
        return fs.getContentSummary(where).getLength()

    def _load(self, name: str) -> dict:
        fs, where = self._fs(f"{self.root}/manifests/{name}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # Batches.

    def manifest(self) -> dict:
        """The batch's own state inside of one, else the newest written."""
        if self._draft is not None:
            return self._draft
        names = self._manifests()
        return self._load(names[-1]) if names else copy.deepcopy(EMPTY)

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifests") if re.fullmatch(r"m\d+\.json", n)]

    @contextlib.contextmanager
    def batch(self) -> Iterator[Store]:
        """All writes inside become visible together at its end, or not at all; a batch inside another is part of it."""
        if self._draft is not None:
            yield self
            return
        self._draft = self.manifest()
        was = json.dumps(self._draft)
        try:
            yield self
            if json.dumps(self._draft) != was:
                self._commit(self._draft)
            for folder in self._made - self._folders(self._draft):  # merged away in the batch that wrote them
                self._delete(folder)
        finally:
            self._draft, self._made = None, set()

    def _commit(self, draft: dict) -> None:
        draft["number"] += 1
        fs, new = self._fs(f"{self.root}/manifests/.new-{uuid.uuid4().hex}")
        stream = fs.create(new, False)
        stream.write(json.dumps(draft).encode())
        stream.close()
        if not fs.rename(new, self._fs(f"{self.root}/manifests/m{draft['number']:010d}.json")[1]):
            raise RuntimeError(f"manifest {draft['number']} of {self.root} exists: another writer was here")
        names = self._manifests()
        held = {f for n in names[-self.keep :] for f in self._folders(self._load(n))}
        for name in names[: -self.keep]:
            for folder in self._folders(self._load(name)) - held:
                self._delete(folder)
            self._delete(f"manifests/{name}")

    @staticmethod
    def _folders(manifest: dict) -> set[str]:
        return {s[k] for t in manifest["tables"].values() for s in t["segments"] for k in ("rows", "keys") if s[k]}

    def vacuum(self) -> int:
        """Delete folders that batches left that broke off; tells how many."""
        held = {f for n in self._manifests() for f in self._folders(self._load(n))}
        found = [f"data/{t}/{x}" for t in self._names("data") for x in self._names(f"data/{t}") if f"data/{t}/{x}" not in held]
        for folder in found:
            self._delete(folder)
        return len(found)

    # Tables.

    def version(self, table: str) -> int:
        """How many batches have changed the table, 0 if there is none."""
        return self.manifest()["tables"].get(table, {}).get("version", 0)

    def marks(self) -> dict[str, str]:
        return dict(self.manifest()["marks"])

    def mark(self, name: str, value: str) -> None:
        with self.batch():
            self._draft["marks"][name] = value

    def _put(self, table: str, rows: DataFrame, *partition_by: str) -> str:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        self._made.add(folder)
        rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{folder}")
        return folder

    def _segment(self, table: str, rows: DataFrame, keys: DataFrame | None, *partition_by: str) -> dict:
        told = {"rows": self._put(table, rows, *partition_by), "keys": None if keys is None else self._put(table, keys), "schema": rows.schema.json()}
        return told | {"bytes": self._size(told["rows"])}

    def write(self, table: str, rows: DataFrame, *partition_by: str) -> None:
        """Put `rows` in place of the whole table."""
        with self.batch():
            segment = self._segment(table, rows, None, *partition_by)
            self._draft["tables"][table] = {"key": None, "version": self.version(table) + 1, "segments": [segment]}

    def replace(self, table: str, rows: DataFrame, touched: DataFrame, key: str = "session_id") -> None:
        """Put `rows` in place of all rows whose key `touched` has."""
        with self.batch():
            held = self._draft["tables"].get(table, {"key": key, "version": 0, "segments": []})
            segments = [*held["segments"], self._segment(table, rows, touched.select(key).distinct() if held["segments"] else None)]
            if len(segments) > self.most:
                sizes = [s["bytes"] for s in segments]
                first = next((i for i in range(len(segments) - 1) if sizes[i] <= 2 * sum(sizes[i + 1 :])), len(segments) - 2)
                segments[first:] = [self._merged(table, segments[first:], key, first == 0)]
            self._draft["tables"][table] = {"key": key, "version": held["version"] + 1, "segments": segments}

    def _merged(self, table: str, segments: list[dict], key: str, whole: bool) -> dict:
        keys = None
        if not whole:
            keys = functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/{s['keys']}") for s in segments]).distinct()
        return self._segment(table, self._rows(segments, key), keys)

    def _rows(self, segments: list[dict], key: str | None) -> DataFrame:
        """Rows of segments, each but where a later one replaces its key."""
        read = lambda s: self.spark.read.schema(T.StructType.fromJson(json.loads(s["schema"]))).parquet(f"{self.root}/{s['rows']}")
        union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        if len(segments) == 1:
            return read(segments[0])
        rows = functools.reduce(union, [read(s).withColumn("_at", F.lit(i)) for i, s in enumerate(segments)])
        later = [self.spark.read.parquet(f"{self.root}/{s['keys']}").withColumn("_last", F.lit(i)) for i, s in enumerate(segments) if s["keys"] and i]
        last = functools.reduce(union, later).groupBy(F.col(key).alias("_key")).agg(F.max("_last").alias("_last"))
        return rows.join(last, F.col(key) == F.col("_key"), "left").filter("_last is null or _last <= _at").drop("_key", "_last", "_at")

    def read(self, table: str, schema=None) -> DataFrame:
        held = self.manifest()["tables"].get(table)
        if held is None:
            if schema is None:
                raise FileNotFoundError(f"no table {table} in {self.root}")
            return self.spark.createDataFrame([], schema)
        return self._rows(held["segments"], held["key"])

    def write_if_changed(self, table: str, rows: DataFrame, *partition_by: str) -> bool:
        """Write unless the table already holds just these rows; tells whether it wrote."""
        digest = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()
        if self.version(table) and sorted(self.read(table).columns) == sorted(rows.columns) and digest(self.read(table)) == digest(rows):
            return False
        self.write(table, rows, *partition_by)
        return True

    # Copies.

    def snapshot(self, target: str) -> dict[str, dict]:
        """Copy all tables as of one manifest to a new folder; returns rows and a hash sum by table, which the copy was checked
        against before its one rename. A target that exists is an error, and a copy that differs leaves none."""
        taken = self.manifest()
        fs, place = self._fs(target.rstrip("/"))
        if fs.exists(place):
            raise FileExistsError(target)
        draft = f"{target.rstrip('/')}.new-{uuid.uuid4().hex}"
        told = {}
        try:
            for table, held in sorted(taken["tables"].items()):
                rows = self._rows(held["segments"], held["key"])
                rows.write.parquet(f"{draft}/{table}")
                told[table], got = _digest(rows), _digest(self.spark.read.schema(rows.schema).parquet(f"{draft}/{table}"))
                if told[table] != got:
                    raise RuntimeError(f"copy of {table} has {got}, the table {told[table]}")
            stream = fs.create(self._fs(f"{draft}/snapshot.json")[1], False)
            stream.write(json.dumps({"manifest": taken["number"], "tables": told}).encode())
            stream.close()
            fs.rename(self._fs(draft)[1], place)
        finally:
            fs.delete(self._fs(draft)[1], True)
        return told


def _digest(rows: DataFrame) -> dict:
    """Rows and an order-free hash sum; every column counts by its JSON form, so any type will do."""
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(whole.cast("decimal(38,0)")).cast("string").alias("h")).first()
    return {"rows": got["n"], "hash": got["h"]}
