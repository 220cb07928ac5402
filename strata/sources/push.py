"""Pushing files to content-addressed objects: a plan, and a Data Source writer that makes objects and one manifest.

A task copies its files through one buffer each, hashes what it copies, and gives an object its name only when the bytes have the
hash of the plan. It lists them in a part of the manifest; the commit names the parts in one file, so a manifest
tells whole pushes alone. An attempt that fails leaves no part behind; an object under its own hash is never wrong, so it may stay.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from strata.operators.sinks import object_key
from strata.sources.bounded import BUFFER, opened
from strata.sources.store import staged

MANIFEST = "object string, file string, sha256 string, bytes long"


def push_plan(files: DataFrame, held: DataFrame | None = None, missing_only: bool = True, limit: int | None = None) -> DataFrame:
    """file, sha256, object to push, of files (file, sha256): of equal contents the first file, without objects that are held (object) where only
    the missing are wanted, and no more than `limit`, in order of the files."""
    keyed = files.select("file", "sha256", object_key(F.col("sha256"), F.col("file")).alias("object"))
    first = keyed.groupBy("object").agg(F.min(F.struct("file", "sha256")).alias("f")).select("f.file", "f.sha256", "object")
    if missing_only and held is not None:
        first = first.join(held.select("object").distinct(), "object", "left_anti").select("file", "sha256", "object")
    return first if limit is None else first.orderBy("file").limit(limit)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Part(WriterCommitMessage):
    """The part of a manifest that a task wrote, and how much it names."""

    name: str
    objects: int
    bytes: int


class ObjectWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.push = root.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Part:
        system, root = _place(self.root)
        name, size, count = f"manifest/parts/{self.push}-{uuid.uuid4().hex}.jsonl", 0, 0
        system.create_dir(f"{root}/manifest/parts", recursive=True)
        try:
            with system.open_output_stream(f"{root}/{name}") as told:
                for row in iterator:
                    done = self.copied(system, root, row)
                    told.write((json.dumps({"object": row.object, "file": row.file, "sha256": row.sha256, "bytes": done}) + "\n").encode())
                    size, count = size + done, count + 1
        except Exception:
            system.delete_file(f"{root}/{name}")
            raise
        return Part(name, count, size)

    def copied(self, system: fs.FileSystem, root: str, row: Row) -> int:
        """Copy one file; tells its bytes."""
        target, digest, size = f"{root}/{row.object}", hashlib.sha256(), 0
        system.create_dir(target.rpartition("/")[0], recursive=True)
        draft = f"{target}.{uuid.uuid4().hex}"
        with opened(row.file) as source, system.open_output_stream(draft) as out:
            while data := source.read(BUFFER):
                digest.update(data)
                out.write(data)
                size += len(data)
        if digest.hexdigest() != row.sha256:
            system.delete_file(draft)
            raise ValueError(f"{row.file} has changed: its hash is {digest.hexdigest()}, the plan's {row.sha256}")
        system.move(draft, target)
        return size

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        system, root = _place(self.root)
        system.create_dir(f"{root}/manifest", recursive=True)
        whole = {"push": self.push, "parts": [p.name for p in parts if p.objects], "objects": sum(p.objects for p in parts), "bytes": sum(p.bytes for p in parts)}
        with system.open_output_stream(f"{root}/manifest/.{self.push}") as out:
            out.write(json.dumps(whole).encode())
        system.move(f"{root}/manifest/.{self.push}", f"{root}/manifest/{self.push}.json")

    def abort(self, messages: list[Part | None]) -> None:
        system, root = _place(self.root)
        for part in messages:
            if part is not None:
                system.delete_file(f"{root}/{part.name}")


class Objects(DataSource):
    """`df.write.format("strata_objects").mode("append").save(root)` for rows (file, sha256, object)."""

    @classmethod
    def name(cls) -> str:
        return "strata_objects"

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"])


def held_objects(spark: SparkSession, root: str) -> DataFrame:
    """object, file, sha256, bytes of all whole pushes to `root`."""
    pushes = spark.read.option("pathGlobFilter", "*.json").schema("parts array<string>").json(f"{root.rstrip('/')}/manifest")
    names = pushes.select(F.explode("parts").alias("part"))
    rows = spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/manifest/parts").withColumn("part", F.concat(F.lit("manifest/parts/"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)))
    return rows.join(names, "part", "left_semi").drop("part").dropDuplicates(["object"])


def push(spark: SparkSession, files: DataFrame, root: str, missing_only: bool = True, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """Push files (file, sha256) to `root`; returns what was to be pushed. A dry run writes nothing."""
    system, place = _place(root)
    known = system.get_file_info(f"{place.rstrip('/')}/manifest/parts").type == fs.FileType.Directory
    plan = staged(push_plan(files, held_objects(spark, root) if known else None, missing_only, limit), "push_plan")
    if not dry_run and not plan.isEmpty():
        spark.dataSource.register(Objects)
        plan.repartition("object").write.format("strata_objects").mode("append").save(root)
    return plan
