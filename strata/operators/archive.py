"""Raw archive: text fragments of records and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import windows
from strata.functions.words import content_fragments, content_text
from strata.sources.transcripts import field, infer_dialect


def numbered(lines: DataFrame) -> DataFrame:
    """file, event_index (from 1, blank lines too), byte_start, byte_end, value."""
    ordered = Window.partitionBy("file").orderBy("seq")
    size = F.octet_length("value") + 1
    sizes = lines.select("file", "seq", size.alias("size"))
    at = sizes.withColumn("event_index", F.row_number().over(ordered)).withColumn("end", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.join(at, ["file", "seq"]).select("file", "seq", "event_index", (F.col("end") - F.col("size")).alias("byte_start"), F.col("end").alias("byte_end"), "value")


def _bare(text: Column) -> Column:
    return F.trim(F.translate(text, "\0", ""), F.lit(" \t\n\r\f\v"))


def _given(path: str) -> Column:
    """A field that says something: null for null, an empty string or an empty list or object."""
    v = field(path, "variant")
    return F.when(~F.to_json(v).isin("null", '""', "[]", "{}", "false", "0"), v)


def _text(v: Column) -> Column:
    """A string as it is, anything else as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with these columns, worked out once whatever reads them: the optimiser moves nothing past an array of one."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return rows.select("*", made.alias("_made")).select(*rows.columns, "_made.*")


def _with_content(rows: DataFrame) -> DataFrame:
    """With type (`record_type`), role and content of a record `v` of its file's dialect; no content where the record says nothing to keep."""
    kind, inner = F.col("_kind"), F.schema_of_variant(field("payload", "variant")).startswith("OBJECT")
    told = _once(rows, _kind=F.coalesce(field("type"), field("record_type")), _inner=F.coalesce(inner, F.lit(False)))
    wrapped = F.col("_inner") & F.coalesce(kind.isin("response_item", "session_meta", "event_msg", "turn_context"), F.lit(False))
    codex, claude = F.col("dialect") == "codex", F.col("dialect") == "claudecode"
    told = _once(told, _wrapped=wrapped, record_type=F.when(codex & wrapped & (kind == "response_item"), field("payload.type")).otherwise(kind))
    of = lambda f, *a: F.when(F.col("_wrapped"), f(f"payload.{a[0]}", *a[1:])).otherwise(f(*a))
    spoken = F.when(F.col("record_type") == "message", of(field, "content", "variant")).when(F.col("record_type") == "reasoning", F.coalesce(of(_given, "summary"), of(_given, "content")))
    turn = F.when(kind.isin("user", "assistant", "system"), F.coalesce(_given("message.content"), _given("content")))
    content = F.when(codex, spoken).when(claude, turn).otherwise(F.coalesce(*map(_given, ("message", "content", "text"))))
    role = F.when(codex, F.when(F.col("record_type") == "reasoning", "reasoning").otherwise(of(field, "role"))).when(claude, F.coalesce(F.nullif(field("message.role"), F.lit("")), kind)).otherwise(field("role"))
    return _once(told, role=role, content=F.to_json(content)).drop("_kind", "_inner", "_wrapped")


def _with_fragments(rows: DataFrame) -> DataFrame:
    """With fragments `fs` (role, tool_name, text) of records `v` with `dialect` and what `_with_content` adds: what messages, calls, results,
    reasoning and events say; of other records nothing. Blocks are walked by the one helper in Python, and records without blocks stay in
    the engine."""
    record = F.col("record_type")
    one = lambda r, name, text: F.array(F.struct(F.lit(r).alias("role"), name.alias("tool_name"), _bare(F.coalesce(text, F.lit(""))).alias("text")))
    none = F.lit(None).cast("string")
    codex, wrapped = F.col("dialect") == "codex", field("payload", "variant").isNotNull()
    at = lambda p: F.when(wrapped, field(f"payload.{p}", "variant")).otherwise(field(p, "variant"))
    is_event = codex & (record == "event_msg") & (F.coalesce(field("payload.type"), F.lit("")) != "token_count")
    rows = _once(rows, event=F.when(is_event, F.to_json(F.coalesce(*[_given(f"payload.{p}") for p in ("message", "content", "text")]))), is_event=is_event,
        tool=F.when(codex & (record == "function_call"), one("tool_use", F.coalesce(field("payload.name"), field("name")), _text(F.coalesce(at("arguments"), F.parse_json(F.lit("{}")))))).when(codex & (record == "function_call_output"), one("tool_result", none, _text(at("output")))))
    rows = _once(rows, walked=content_fragments("content", "role", "record_type"), heard=content_text("event"))
    return rows.withColumn("fs", F.coalesce("tool", F.when(F.col("is_event"), one("event", none, F.col("heard"))), "walked")).drop("tool", "event", "is_event", "walked", "heard", "role", "content")


def _is_object() -> Column:
    return F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))


def chunks(lines: DataFrame, most: int = 12_000, overlap: int = 400) -> DataFrame:
    """file, event_index, fragment_index, chunk_index, byte_start, byte_end, session_id, record_type, kind, role, tool_name, text.

    `lines` may have the dialect of each file; else it is inferred. A session id holds on to the lines below it; a line
    that is no JSON object is one raw fragment. Kinds are message, tool_use, tool_result, reasoning, event and raw.
    """
    known = "dialect" in lines.columns
    v = lines.select("file", "seq", (F.octet_length("value") + 1).alias("size"), *["dialect"] * known, F.explode(F.array(F.try_parse_json("value"))).alias("v"))
    named = F.coalesce(*[F.nullif(field(p + k), F.lit("")) for p in ("payload.", "message.", "") for k in ("session_id", "sessionId", "conversation_id")])
    opened = F.when(F.coalesce(field("type"), field("record_type")) == "session_meta", F.coalesce(field("payload.id"), field("id")))
    # A line's place and session are worked out on narrow rows, once; the line meets them once, and is walked after that.
    narrow = v.select("file", "seq", "size", *["dialect"] * known, F.when(_is_object(), F.struct(named.alias("named"), opened.alias("opened"))).alias("own"))
    narrow = narrow if known else narrow.join(infer_dialect(lines), "file")
    own = F.coalesce("own.named", F.when(F.col("dialect") == "codex", F.col("own.opened")))
    ordered = Window.partitionBy("file").orderBy("seq")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    at = narrow.select("file", "seq", "size", *["dialect"] * (not known), F.row_number().over(ordered).alias("event_index"), F.sum("size").over(so_far).alias("byte_end"), F.last(own, ignorenulls=True).over(so_far).alias("session_id"))
    rows = lines.filter(F.trim("value") != "").join(at, ["file", "seq"]).select("*", (F.col("byte_end") - F.col("size")).alias("byte_start"), F.explode(F.array(F.try_parse_json("value"))).alias("v"))
    place = ("file", "seq", "event_index", "byte_start", "byte_end", "session_id")
    rows = _with_fragments(_with_content(_once(rows, object=_is_object())))
    raw = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("tool_name"), _bare(F.col("value")).alias("text")))
    said = _once(rows.withColumn("record_type", F.when(F.col("object"), F.col("record_type")).otherwise("raw")), said=F.when(F.col("object"), F.col("fs")).otherwise(raw)).drop("fs").withColumnRenamed("said", "fs")
    cut = said.select(*place, "record_type", F.posexplode("fs").alias("fragment_index", "f")).filter("f.text <> ''")
    kind = F.when(F.col("record_type") == "raw", "raw").when(F.col("role").isin("tool_use", "tool_result", "reasoning", "event"), F.col("role")).otherwise("message")
    out = cut.select(*place, "fragment_index", "record_type", "f.role", "f.tool_name", F.explode(windows(F.col("f.text"), most, overlap)).alias("w"))
    return out.select("file", "event_index", "fragment_index", F.col("w.chunk_index").alias("chunk_index"), "byte_start", "byte_end", "session_id", "record_type", kind.alias("kind"), "role", "tool_name", F.col("w.chunk").alias("text"))


def show(rows: DataFrame, session_id: str) -> DataFrame:
    return rows.filter(F.col("session_id") == session_id).orderBy("file", "event_index", "fragment_index", "chunk_index")


def unindexed(files: DataFrame, held: DataFrame, key: str = "file") -> DataFrame:
    """Line-delimited files without chunks."""
    return files.filter(F.regexp_like(F.col(key), F.lit(r"\.(?:jsonl|ndjson)$"))).join(held.select(key).distinct(), key, "left_anti")
