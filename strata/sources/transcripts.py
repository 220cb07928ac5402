"""Line-delimited JSON transcripts: discovery, ordered lines, records as VARIANT, and rejected lines."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators.filters import ignored

# Transcript roots below a home folder with their dialect, in order of priority.
ROOTS = (
    (".claude/projects", "claudecode"),
    (".codex/sessions", "codex"),
    (".codex/archived_sessions", "codex_archive"),
    (".codex-2/sessions", "codex"),
    (".codex-3/sessions", "codex"),
)
# JSON types that a field may have where it is present. Paths of one dot are optional
# objects' fields; a missing field is always good.
FIELD_TYPES = {
    "type": ("STRING",), "record_type": ("STRING",), "timestamp": ("STRING",), "cwd": ("STRING", "VOID"), "id": ("STRING", "BIGINT", "BOOLEAN", "VOID"),
    "message": ("OBJECT",), "payload": ("OBJECT",),
    "message.id": ("STRING", "BIGINT", "BOOLEAN"), "message.content": ("STRING", "ARRAY", "OBJECT"), "message.usage": ("OBJECT",), "message.model": ("STRING", "VOID"),
    "payload.type": ("STRING",), "payload.id": ("STRING", "BIGINT", "BOOLEAN"), "payload.call_id": ("STRING", "BIGINT", "BOOLEAN"), "payload.content": ("STRING", "ARRAY", "OBJECT"),
    "payload.cwd": ("STRING", "VOID"), "payload.model": ("STRING", "VOID"), "payload.timestamp": ("STRING", "VOID"),
    "payload.source.subagent.thread_spawn.parent_thread_id": ("STRING", "BIGINT", "BOOLEAN", "VOID"),
}
# Fields that must read as whole numbers.
NUMBERS = (
    "message.usage.input_tokens", "message.usage.cache_read_input_tokens", "message.usage.cache_creation_input_tokens", "message.usage.output_tokens",
    "message.usage.cache_creation.ephemeral_5m_input_tokens", "message.usage.cache_creation.ephemeral_1h_input_tokens",
    "payload.source.subagent.thread_spawn.depth",
)
TOKEN_NUMBERS = tuple(f"payload.info.total_token_usage.{k}" for k in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"))
#: Longest line that is read, in bytes.
MOST_BYTES = 64 << 20


def roots(home: str) -> list[tuple[str, str, int]]:
    """(folder, dialect, priority) of each root."""
    return [(f"{home.rstrip('/')}/{path}", dialect, i) for i, (path, dialect) in enumerate(ROOTS)]


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """file, seq, value: all lines of the files of a pattern below `paths`, each read whole; `bounded.read_lines` has a bound.

    seq orders the lines of a file however the file is split; no line is moved to number it.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(paths)
    seq = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    # The metadata has paths as URIs; everything else has them as they are.
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select(plain.alias("file"), seq.alias("seq"), "value")


def files(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """file, size, modified of each file of the pattern, without reading it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def changed_files(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files without a ledger row of the same path, size and time (to a microsecond)."""
    known = ledger.select(F.col("file").alias("f"), F.col("size").alias("s"), F.col("modified").alias("m"))
    same = (F.col("file") == F.col("f")) & (F.col("size") == F.col("s")) & (F.abs(F.unix_micros("modified") - F.unix_micros("m")) <= 1)
    return found.join(known, same, "left_anti")


def transcripts_only(rows: DataFrame, ignore: list[str] | tuple[str, ...] = (), file: str = "file") -> DataFrame:
    """Rows of files that are transcripts: no workflow journals, nothing ignored."""
    journal = F.regexp_like(F.col(file), F.lit(r"/subagents/(?:.*/)?workflows/(?:.*/)?journal\.jsonl$"))
    return rows.filter(~journal & ~ignored(F.col(file), ignore))


def first_stem(rows: DataFrame, file: str = "file", priority: str = "priority") -> DataFrame:
    """Of files with one stem the one of the first root."""
    stem = F.regexp_extract(F.col(file), r"([^/]*?)(?:\.jsonl)?$", 1)
    return rows.withColumn("stem", stem).withColumn("_n", F.row_number().over(Window.partitionBy("stem").orderBy(priority, file))).filter("_n = 1").drop("_n")


def _at(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "variant")


def field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


#: A cast that tells the names of an object's fields and which of them are objects, and looks at no other value.
_NAMES = "map<string,struct<_:boolean>>"


def reject_reason() -> Column:
    """The first field whose type would make a record unsafe, of a record `v`; null if none. Names are asked an object at a time, and only
    fields that it has are looked up: to miss a field costs Spark an exception. A schema goes through all of a value, so arrays are told by
    a cast."""
    record = F.coalesce(field("type"), field("record_type"))
    token, call, named = field("payload.type") == "token_count", (record == "response_item") & (field("payload.type") == "function_call"), record == "function_call"
    number = lambda path: field(path, "double").isNotNull() | F.is_variant_null(_at(path))

    def typed(path: str, kinds: tuple[str, ...], is_object: Column) -> Column:
        good = F.schema_of_variant(_at(path)).isin(*kinds) if kinds != ("OBJECT",) else F.lit(False)
        good = field(path, "array<boolean>").isNotNull() | good if "ARRAY" in kinds else good
        return is_object | good if "OBJECT" in kinds else good
    # Path, whether a field there is good, of whether it is an object, and where that is asked.
    checks = [(p, lambda o, p=p, k=k: typed(p, k, o), None) for p, k in FIELD_TYPES.items()] + [(p, lambda o, p=p: number(p), None) for p in NUMBERS]
    checks += [(p, lambda o, p=p: typed(p, ("OBJECT",), o), token) for p in ("payload.info", "payload.info.total_token_usage")] + [(p, lambda o, p=p: number(p), token) for p in TOKEN_NUMBERS]
    checks += [("name", lambda o: typed("name", ("STRING",), o), named), ("payload.name", lambda o: typed("payload.name", ("STRING",), o), call)]
    tree: dict = {}
    for order, (path, good, where) in enumerate(checks):
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})
        node[None] = order, good, where

    def first(node: dict, prefix: str) -> Column:
        """The least order of a bad field below an object."""
        def below(names: Column) -> Column:
            found = []
            for part, child in node.items():
                if part is None:
                    continue
                is_object, inner = names[part].isNotNull(), {k: c for k, c in child.items() if k is not None}
                if None in child:
                    order, good, where = child[None]
                    bad = ~good(is_object) if where is None else where & ~good(is_object)
                    found.append(F.when(F.map_contains_key(names, F.lit(part)) & bad, F.lit(order)))
                if inner:
                    found.append(F.when(is_object, first(inner, f"{prefix}{part}.")))
            return F.array_min(F.array(*found))
        return F.get(F.transform(F.array(field(prefix.rstrip("."), _NAMES) if prefix else F.try_variant_get("v", "$", _NAMES)), below), 0)
    return F.get(F.array(*[F.lit(path) for path, _, _ in checks]), first(tree, ""))


def parsed_lines(lines: DataFrame, most_chars: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """file, seq, v, reject and the columns to `keep`: every line that is not blank, parsed; `reject` says why a line is no record.

    Both come out of an array of one, past which the optimiser moves no filter, so that neither is worked out twice."""
    # The line too, else a line that is made of other columns is made once to be filtered and again to be parsed.
    rows = lines.withColumn("value", F.explode(F.array("value"))).filter(F.trim("value") != "")
    bounded = F.lit(True) if most_chars is None else F.char_length("value") <= most_chars
    v = F.when(bounded, F.try_parse_json("value"))
    rows = rows.select("file", "seq", *keep, "value", bounded.alias("bounded"), F.explode(F.array(v)).alias("v"))
    is_object = F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("{"))
    reject = F.when(~F.col("bounded"), "too_long").when(F.col("v").isNull(), "invalid_json").when(~is_object, "not_object").otherwise(reject_reason())
    return rows.select("file", "seq", "v", F.explode(F.array(reject)).alias("reject"), *keep)


def records(lines: DataFrame, most_chars: int | None = None) -> DataFrame:
    """file, seq, v of the good records."""
    return parsed_lines(lines, most_chars).filter("reject is null").select("file", "seq", "v")


def reject_counts(lines: DataFrame, most_chars: int | None = None) -> DataFrame:
    return parsed_lines(lines, most_chars).filter("reject is not null").groupBy("file", "reject").agg(F.count(F.lit(1)).alias("lines"))


def infer_dialect(lines: DataFrame, first: int = 20) -> DataFrame:
    """file, dialect by the first lines of each file: claudecode keys, then codex shapes, else jsonl."""
    number = F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    v = lines.select("file", "seq", F.try_parse_json("value").alias("v"))
    claude = field("sessionId").isNotNull() | field("parentUuid").isNotNull() | (field("type").isin("user", "assistant") & field("message", "variant").isNotNull())
    codex = field("payload", "variant").isNotNull() | field("record_type").isNotNull() | field("type").isin("session_meta", "event_msg", "turn_context", "response_item", "message", "function_call", "function_call_output", "reasoning")
    told = v.select("file", "seq", F.when(claude, "claudecode").when(codex, "codex").alias("label")).withColumn("n", number).filter(F.col("n") <= first)
    return told.groupBy("file").agg(F.coalesce(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("n"))), F.lit("jsonl")).alias("dialect"))


def project_of_path(path: Column) -> Column:
    """Project of a transcript's encoded folder: its last dash-separated part of two or more characters."""
    bare = F.regexp_replace(path, r"/[^/]*/subagents/.*$", "/x.jsonl")
    folder = F.regexp_extract(bare, r"([^/]*)/[^/]*$", 1)
    return F.try_element_at(F.filter(F.split(folder, "-"), lambda p: F.char_length(p) > 1), F.lit(-1))


def holds_marker(markers: tuple[str, ...]) -> Column:
    """Whether a line has one of the privacy markers; which strings mark one is the caller's to say."""
    return functools.reduce(operator.or_, [F.contains("value", F.lit(m)) for m in markers], F.lit(False))


def private_files(rows: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Files with one of the privacy markers anywhere in a record."""
    return rows.filter(holds_marker(markers)).select("file").distinct()
