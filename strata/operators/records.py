"""Session tables from transcript records of both dialects.

`claude(records)` and `codex(records)` take (file, seq, v) and return tables by name: sessions, messages,
tool_calls, events (per-message usage with its day), turns, and for claudecode claims. What several of them share (calls, events,
ids and the like, all without the records) is written once, so that no table works it out again and plans stay small.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.classify import event_day, event_time, operation, zero
from strata.functions.text import is_agents_payload, strip_preamble
from strata.functions.words import content_text
from strata.operators import usage
from strata.operators.paths import argument_paths, command_paths, first_word
from strata.sources.store import staged
from strata.sources.transcripts import field

USAGE_TYPE = "struct<input_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, output_tokens bigint, cache_creation struct<ephemeral_5m_input_tokens bigint, ephemeral_1h_input_tokens bigint>, iterations array<struct<input_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, output_tokens bigint, cache_creation struct<ephemeral_5m_input_tokens bigint, ephemeral_1h_input_tokens bigint>>>>"
#: Counters of a message or day.
MEASURES = ("fresh_input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "cache_creation_5m_input_tokens", "cache_creation_1h_input_tokens", "cache_creation_unknown_input_tokens", "total_input_tokens", "total_output_tokens", "reasoning_output_tokens", "user_message_count", "assistant_message_count", "tool_call_count")


def vget(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]*?)(?:\.jsonl)?$", 1)


def blocks(path: str) -> Column:
    """Content blocks of a record: an array as it is, an object alone."""
    return F.coalesce(field(path, "array<variant>"), F.when(F.schema_of_variant(field(path, "variant")).startswith("OBJECT"), F.array(field(path, "variant"))), F.array().cast("array<variant>"))


def typed_blocks(get, kinds: tuple[str, ...], bare: bool = False, path: str = "content") -> Column:
    """Texts of string content or of blocks of these types, one entry each; with `bare` also of blocks of just a text. `get` reads
    a field of the record."""
    raw = get(path, "variant")
    many = F.coalesce(get(path, "array<variant>"), F.when(F.schema_of_variant(raw).startswith("OBJECT"), F.array(raw)), F.array().cast("array<variant>"))

    def fits(b: Column) -> Column:
        good = F.coalesce(vget(b, "type").isin(*kinds), F.lit(False))
        return good | (F.schema_of_variant(b) == "OBJECT<text: STRING>") if bare else good
    texts = F.transform(F.filter(many, lambda b: fits(b) & (F.schema_of_variant(vget(b, "text", "variant")) == "STRING")), lambda b: vget(b, "text"))
    return F.when(F.schema_of_variant(raw) == "STRING", F.array(get(path))).otherwise(texts)


def spoken(texts: Column, searched: Column, user: bool = False) -> Column:
    """What of a turn's texts is indexed, one entry each: of a user's what follows the harness's wrappers, unless it is a
    message of instructions; nothing of a turn that is not searched."""
    bare = F.transform(texts, lambda t: strip_preamble(t)) if user else texts
    own = F.filter(bare, lambda t: (F.trim(t) != "") & ~is_agents_payload(t)) if user else bare
    return F.when(searched, own).otherwise(F.array().cast("array<string>"))


def _blank(*names: str) -> list[Column]:
    return [F.lit(0).cast("long").alias(n) for n in names]


def _first(column: Column, order: str = "seq") -> Column:
    return F.min_by(column, F.when(column.isNotNull(), F.col(order)))


#: Tables of claudecode records, and the columns of `fields` that each is made of.
_CLAUDE = {
    "ids": ("ts", "raw_session", "agent", "side", "cwd"), "messages": ("rtype", "ts", "message_id", "request_id", "uuid", "u"), "claims": (), "tool_calls": ("ts", "calls", "results"),
    "turns": ("rtype", "ts", "meta", "has_result", "texts"), "events": ("rtype", "ts", "message_id", "u", "has_result", "texts", "calls"),
    "heads": ("rtype", "message_id", "model", "meta", "has_result", "texts", "calls", "results"),
    "sessions": ("rtype", "ts", "message_id", "model", "u", "meta", "has_result", "texts", "calls", "results"),
}
#: What `heads` has besides `ids`.
COUNTED = ("user_message_count", "tool_call_count", "error_count", "first_user_message", "model")


#: What is read of a content block for a column of `_fields`; text as it is, for its type counts.
_BLOCK = {"results": ("tool_use_id string", "is_error boolean"), "texts": ("text variant",), "calls": ("id string", "name string", "input variant")}


def _fields(records: DataFrame, columns: set[str]) -> DataFrame:
    """What claudecode records say, one column for each of `columns`, so that a record is gone through once and its content is cast once."""
    columns = columns | ({"results"} if "has_result" in columns else set())
    inner = [f for c, fields in _BLOCK.items() if c in columns for f in fields]
    block = f"struct<{', '.join(['type string', *inner])}>"
    user, assistant = F.col("rtype") == "user", F.col("rtype") == "assistant"
    top = {"rtype": "type string", "ts": "timestamp string", "raw_session": "sessionId string", "agent": "agentId string", "side": "isSidechain boolean", "cwd": "cwd string", "meta": "isMeta boolean", "request_id": "requestId string", "uuid": "uuid string"}
    of_message = {"message_id": "id string", "model": "model string", "u": f"usage {USAGE_TYPE}"}
    message = [t for c, t in of_message.items() if c in columns] + [f"content array<{block}>"] * bool(inner)
    # One cast of the record reads all fields: to look up one that it has not costs Spark an exception. Past an array of one the optimiser
    # moves nothing, so the record is not cast again for each use.
    kinds = ", ".join([t for c, t in top.items() if c in columns or c == "rtype"] + [f"message struct<{', '.join(message)}>"] * bool(message))
    rows = records.select("file", "seq", "v", F.explode(F.array(F.try_variant_get("v", "$", f"struct<{kinds}>"))).alias("r"))
    made = lambda c: F.col(f"r.{top[c].split()[0]}" if c in top else f"r.message.{of_message[c].split()[0]}")
    kept = {c: made(c) for c in top if c in columns or c == "rtype"} | {c: F.when(F.col("r.type") == "assistant", made(c)) for c in ("message_id", "model", "request_id", "uuid") if c in columns}
    for c in {"side", "meta"} & columns:
        kept[c] = F.coalesce(kept[c], F.lit(False))
    if "cwd" in columns:
        kept["cwd"] = F.nullif(kept["cwd"], F.lit(""))
    if "u" in columns:
        kept["full"] = F.when(F.col("r.type") == "assistant", made("u"))
    if inner:
        # Content that is no array: a block alone, or bare text.
        other = F.col("r.type").isin("user", "assistant") & F.col("r.message").isNotNull() & F.col("r.message.content").isNull()
        kept |= {"blocks": F.when(F.col("r.type").isin("user", "assistant"), F.col("r.message.content")), "block": F.when(other, field("message.content", block))}
        if "texts" in columns:
            kept["bare"] = F.when(other & (F.schema_of_variant(field("message.content", "variant")) == "STRING"), field("message.content"))
    rows = rows.select("file", "seq", *[e.alias(c) for c, e in kept.items()])
    more = {}
    if inner:
        content = F.coalesce("blocks", F.when(F.col("block").isNotNull(), F.array("block")), F.array().cast(f"array<{block}>"))
        of = lambda kind: F.filter(content, lambda b: F.coalesce(b["type"] == kind, F.lit(False)))

        def call(b: Column, place: Column) -> Column:
            cmd = F.coalesce(*[F.nullif(c, F.lit("")) for k in ("command", "cmd") for c in (F.array_join(vget(b["input"], k, "array<string>"), " "), vget(b["input"], k))])
            return F.when(F.coalesce(b["type"] == "tool_use", F.lit(False)), F.struct(place.cast("int").alias("place"), F.coalesce(b["name"], F.lit("unknown")).alias("tool_name"), b["id"].alias("call_id"), cmd.alias("command"), F.to_json(b["input"]).alias("arguments")))
        result = lambda b: F.struct(b["tool_use_id"].alias("call_id"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error"))
        if "results" in columns:
            more["results"] = F.when(user, F.transform(of("tool_result"), result))
        if "texts" in columns:
            text = F.transform(F.filter(of("text"), lambda b: F.schema_of_variant(b["text"]) == "STRING"), lambda b: b["text"].cast("string"))
            more["texts"] = F.when(user | assistant, F.when(F.col("bare").isNotNull(), F.array("bare")).otherwise(text))
        if "calls" in columns:
            more["calls"] = F.when(assistant, F.array_compact(F.transform(content, call)))
    if "u" in columns:
        more["u"] = F.when(assistant, F.struct(*[zero(F.col(f"full.{k}")).alias(k) for k in usage.USAGE], F.col("full.cache_creation").alias("cache_creation"), F.col("full.iterations").alias("iterations")))
    rows = rows.select("file", "seq", *[c for c in (*top, "message_id", "model") if c in kept], *[e.alias(c) for c, e in more.items()])
    return rows.withColumn("has_result", F.coalesce(F.size("results") > 0, F.lit(False))) if "has_result" in columns else rows


def claude(records: DataFrame, wanted: tuple[str, ...] = ("sessions", "messages", "tool_calls", "events", "claims", "turns")) -> dict[str, DataFrame]:
    """The `wanted` tables (`ids` has what a file says of its session, `heads` its counts, title and model besides: all of a session but
    its usage). Records are read once, for the columns that these tables are made of; what stands in the way of one table alone is not
    written. `ids`, `heads` or `sessions` alone is one aggregation over the records; `turns` or `tool_calls` alone finds its session in a window
    of the file, so records that come dealt by file are moved no more and nothing is written."""
    columns = {c for name in wanted for c in (*_CLAUDE[name], *(_CLAUDE["messages"] if name == "claims" else ()), *_CLAUDE["ids"] * (name != "messages"))}
    fields = _fields(records, columns)
    alone = wanted[0] if len(wanted) == 1 else None
    if alone not in ("ids", "heads", "sessions", "turns", "tool_calls"):
        fields = staged(fields, "fields")
    shared = staged if len(wanted) > 1 else lambda rows, label: rows
    col = F.col

    #: Counters of a row with usage `u` and its `split`.
    counted = [c.alias(m) for m, c in zip(MEASURES, (
        col("u.input_tokens"), col("u.cache_read_input_tokens"), col("u.cache_creation_input_tokens"), col("split.five_minutes"), col("split.one_hour"), col("split.unknown"),
        col("u.input_tokens") + col("u.cache_read_input_tokens") + col("u.cache_creation_input_tokens"), col("u.output_tokens")))]

    @functools.cache
    def typed() -> DataFrame:
        rows = fields.filter("rtype = 'user' and not has_result").select("file", "seq", "ts", "texts", *[c for c in ("meta",) if c in fields.columns])
        return shared(rows.withColumn("text", F.trim(F.array_join("texts", " "))).filter("text <> ''"), "typed")

    @functools.cache
    def messages() -> DataFrame:
        said = fields.filter("rtype = 'assistant' and message_id is not null and message_id <> ''").withColumn("split", usage.cache_split(col("u")))
        counts = said.select("file", "seq", "ts", "message_id", *[c for c in ("model", "request_id", "uuid") if c in fields.columns], *counted)
        if alone == "claims":
            # Dealt before copies are told apart, with no more than claims have: else each task sorts the messages of its whole part of the fields.
            counts = claimed(counts).select("file", "seq", "message_id", "claim_key", "day", *MEASURES[:8]).repartition("file", "message_id")
        return shared(usage.dedupe_messages(counts, output="total_output_tokens", order="seq"), "messages")

    #: What a file's records say of its session.
    told = {"first_timestamp": _first(F.nullif(col("ts"), F.lit(""))), "last_timestamp": F.max_by("ts", F.when(col("ts") != "", col("seq"))), "raw_session": _first(col("raw_session")), "agent": _first(col("agent")),
            "side": F.max("side"), "cwd": _first(col("cwd")), "fallback_day": _first(event_day(col("ts")))}

    def identified(scalars: DataFrame) -> DataFrame:
        name, path = stem(col("file")), col("file")
        depth = F.size(F.filter(F.split(path, "/"), lambda p: p == "subagents"))
        agent = F.coalesce("agent", F.when(name.startswith("agent-"), F.substring(name, F.lit(7), F.char_length(name))))
        is_sub = col("side") | (depth > 0) | agent.isNotNull()
        raw_agent = F.coalesce(agent, name)
        parent = F.coalesce("raw_session", F.nullif(F.regexp_extract(path, r"^.*?([^/]+)/subagents/", 1), F.lit("")))
        return scalars.select("*", F.coalesce("cwd", F.lit("unknown")).alias("project"), F.when(is_sub, F.when(raw_agent.startswith("agent-"), raw_agent).otherwise(F.concat(F.lit("agent-"), raw_agent))).otherwise(name).alias("session_id"),
            F.when(is_sub, raw_agent).otherwise(F.coalesce("raw_session", name)).alias("thread_id"), F.when(is_sub, parent).alias("parent_thread_id"), F.when(is_sub, F.greatest(F.lit(1), depth)).otherwise(0).alias("spawn_depth"))

    def scalars(rows: DataFrame, *more: Column) -> DataFrame:
        """A row a file: what it says of its session, and `more` aggregates."""
        if alone == "claims":
            return identified(_told_by_agent(rows))
        return identified(rows.groupBy("file").agg(*more, *[e.alias(c) for c, e in told.items()]))

    #: What a row has of its session; one table alone finds it in the pass that makes the table, others meet the written ids.
    own = ("session_id", "workspace_root", "fallback_day") if alone in ("turns", "tool_calls") else ()

    def placed(*kept: str) -> DataFrame:
        if not own:
            return fields.select("file", "seq", *kept)
        of_file = fields.select("file", "seq", *kept, *[e.over(Window.partitionBy("file")).alias(c) for c, e in told.items()])
        return identified(of_file).select("file", "seq", *kept, "session_id", col("project").alias("workspace_root"), "fallback_day")

    def named(rows: DataFrame) -> DataFrame:
        return rows if own else _named(rows, ids())

    @functools.cache
    def calls() -> DataFrame:
        """Calls and results come out of one walk over the records and meet in one window."""
        many = ("tool_name", "command", "arguments")
        call = F.transform("calls", lambda c: F.struct(c["place"].alias("place"), c["call_id"].alias("call_id"), *[c[k].alias(k) for k in many], F.lit(True).alias("_call"), F.lit(None).cast("boolean").alias("_error")))
        result = F.transform(F.filter("results", lambda r: r["call_id"].isNotNull()), lambda r: F.struct(F.lit(1 << 30).alias("place"), r["call_id"].alias("call_id"), *[F.lit(None).cast("string").alias(k) for k in many], F.lit(False).alias("_call"), r["is_error"].alias("_error")))
        both = placed("ts", "calls", "results").select("file", "seq", "ts", *own, F.explode(F.coalesce(call, result)).alias("e"))
        both = both.select("file", F.struct("seq", "e.place").alias("seq"), col("ts").alias("timestamp"), *own, "e.call_id", *[f"e.{k}" for k in many], "e._call", "e._error")
        return shared(_with_paths(usage.with_results(both)), "calls")

    @functools.cache
    def ids() -> DataFrame:
        return heads().drop(*COUNTED, *MEASURES[:8], "assistant_message_count") if "sessions" in wanted else shared(scalars(fields), "ids")

    @functools.cache
    def heads() -> DataFrame:
        """Counts are summed in the aggregation that finds the ids, so no other table is made and joined for them; for sessions usage is too."""
        # Past an array of one the optimiser moves nothing, so a text is not worked out again for each of its uses.
        said = fields.withColumn("text", F.explode(F.array(F.when((col("rtype") == "user") & ~col("has_result"), F.trim(F.array_join("texts", " "))))))
        rows = said.select("file", "seq", *_CLAUDE["ids"], "message_id", "meta", *[c for c in ("u",) if "sessions" in wanted], F.coalesce(col("text") != "", F.lit(False)).alias("spoke"), F.substring("text", 1, 500).alias("title"), F.when(col("message_id") != "", F.nullif(col("model"), F.lit(""))).alias("named"),
            F.size(F.filter("results", lambda r: r["is_error"])).alias("errors"), F.size("calls").alias("called"))
        sums = []
        if "sessions" in wanted:
            rows = rows.select("*", F.explode(F.array(usage.cache_split(col("u")))).alias("split")).select("*", *counted).drop("u", "split")
            # Of a message's copies the fullest counts, of equals the first.
            copy = F.row_number().over(Window.partitionBy("file", "message_id").orderBy(F.desc("total_output_tokens"), "seq"))
            rows = rows.withColumn("counts", (col("message_id") != "") & (copy == 1))
            sums = [*[F.sum(F.when(col("counts"), col(m))).cast("long").alias(m) for m in MEASURES[:8]], F.count_if("counts").alias("assistant_message_count")]
        return shared(scalars(rows, F.count_if("spoke").alias("user_message_count"), F.sum(F.when(col("called") > 0, col("called"))).alias("tool_call_count"), F.sum(F.when(col("errors") > 0, col("errors"))).alias("error_count"),
            F.min_by("title", F.when(col("spoke") & ~col("meta"), col("seq"))).alias("first_user_message"), _first(col("named")).alias("model"), *sums), "heads")

    @functools.cache
    def events() -> DataFrame:
        used = fields.select("file", "ts", F.explode("calls").alias("c")) if len(wanted) == 1 else calls().withColumnRenamed("timestamp", "ts")
        return shared(
            messages().select("file", event_day(col("ts")).alias("day"), *MEASURES[:8], *_blank("reasoning_output_tokens", "user_message_count"), F.lit(1).cast("long").alias("assistant_message_count"), *_blank("tool_call_count"))
            .unionByName(typed().select("file", event_day(col("ts")).alias("day"), *_blank(*MEASURES[:9]), F.lit(1).cast("long").alias("user_message_count"), *_blank("assistant_message_count", "tool_call_count")))
            .unionByName(used.select("file", event_day(col("ts")).alias("day"), *_blank(*MEASURES[:11]), F.lit(1).cast("long").alias("tool_call_count"))), "events")

    def sessions() -> DataFrame:
        return _session_columns(heads().select("*", *_blank("reasoning_output_tokens")), "claudecode")

    def claimed(rows: DataFrame) -> DataFrame:
        key = F.when(col("request_id").isNotNull(), F.concat("message_id", F.lit(":"), "request_id")).when(col("uuid").isNotNull(), F.concat(F.lit("uuid:"), "uuid")).otherwise(F.concat(F.lit("mid:"), "message_id"))
        return rows.withColumns({"claim_key": key, "day": event_day(col("ts"))})

    def claims() -> DataFrame:
        rows = messages() if alone else claimed(messages())
        return rows.join(ids().select("file", "session_id", "fallback_day"), "file").select("claim_key", "session_id", F.coalesce("day", "fallback_day").alias("day"), *MEASURES[:8])

    def turns() -> DataFrame:
        user, joined, searched = col("rtype") == "user", F.array_join("texts", " "), ~col("meta")
        rows = placed("rtype", "meta", "has_result", "texts").filter((user & ~col("has_result")) | (col("rtype") == "assistant"))
        rows = rows.select("file", "seq", F.when(user, "user").otherwise("assistant").alias("role"), F.when(user, F.trim(joined)).otherwise(joined).alias("text"), searched.alias("searched"),
            F.when(user, spoken(col("texts"), searched, user=True)).otherwise(spoken(col("texts"), searched)).alias("spoken"), *own)
        return named(rows.filter("text <> ''"))

    made = {"ids": ids, "messages": messages, "claims": claims, "turns": turns, "heads": heads, "sessions": sessions, "events": lambda: _named(events(), ids()), "tool_calls": lambda: named(calls())}
    return {name: made[name]() for name in wanted}


def _told_by_agent(rows: DataFrame) -> DataFrame:
    """A row a file with what `told` in `claude` finds. Rows come down to one of each agent of a file first, and a file has few. Of these
    the columns that claims ask have a fixed width, so Spark counts them in a hash table; for a first text it sorts all rows before."""
    at = lambda e: F.when(e, F.col("seq"))
    firsts = {"first_timestamp": F.nullif(F.col("ts"), F.lit("")), "raw_session": F.col("raw_session"), "cwd": F.col("cwd"), "fallback_time": event_time(F.col("ts"))}
    lasts = F.max_by("ts", at(F.col("ts") != "")).alias("last_timestamp"), F.max(at(F.col("ts") != "")).alias("last_seq")
    of_agent = rows.groupBy("file", "agent").agg(F.min("seq").alias("seq"), F.max("side").alias("side"), *lasts, *[a for c, e in firsts.items() for a in (_first(e).alias(c), F.min(at(e.isNotNull())).alias(f"{c}_seq"))])
    of_file = of_agent.groupBy("file").agg(_first(F.col("agent")).alias("agent"), F.max("side").alias("side"), F.max_by("last_timestamp", "last_seq").alias("last_timestamp"), *[F.min_by(c, f"{c}_seq").alias(c) for c in firsts])
    return of_file.withColumn("fallback_day", F.date_format("fallback_time", "yyyy-MM-dd")).drop("fallback_time")


def _with_paths(calls: DataFrame) -> DataFrame:
    worded = calls.select("*", argument_paths(F.col("arguments")).alias("input_paths"), command_paths(F.col("command")).alias("command_paths"), first_word(F.col("command")).alias("word"))
    out = worded.withColumn("operation", operation(F.col("tool_name"), F.col("command"), F.col("word"))).drop("word", "arguments")
    return out.withColumn("command", F.substring("command", 1, 500))


def _named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("file", "session_id", F.col("project").alias("workspace_root"), "fallback_day"), "file")


def _sessions(ids: DataFrame, events: DataFrame, title: DataFrame, model: DataFrame, errors: DataFrame, source: str) -> DataFrame:
    sums = events.groupBy("file").agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
    return _session_columns(ids.join(sums, "file", "left").join(title, "file", "left").join(model, "file", "left").join(errors, "file", "left"), source)


def _session_columns(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("session_id", "file", F.lit(source).alias("source"), "project", F.col("project").alias("workspace_root"), "first_timestamp", "last_timestamp", "fallback_day", "thread_id", "parent_thread_id", "spawn_depth", "model",
                      F.coalesce("first_user_message", F.lit("")).alias("first_user_message"), zero(F.col("error_count")).alias("error_count"), *[zero(F.col(m)).alias(m) for m in MEASURES])


def daily(tables: dict[str, DataFrame]) -> DataFrame:
    """Day rows whose sums are the session totals; usage without a day goes to the fallback day."""
    summed = usage.daily_usage(tables["events"], MEASURES)
    totals = tables["sessions"].withColumn("fallback_day", F.coalesce("fallback_day", F.lit("1970-01-01")))
    return usage.reconcile(summed, totals, "fallback_day", MEASURES)


def wrapped() -> Column:
    """Whether a record `v` has its fields in a payload."""
    kind = F.coalesce(field("type"), field("record_type"), F.lit(""))
    inner = F.schema_of_variant(field("payload", "variant")).startswith("OBJECT")
    return F.coalesce(inner & kind.isin("response_item", "session_meta", "event_msg", "turn_context"), F.lit(False))


def codex_type() -> Column:
    """The type of a normalised record, of rows with `v` and `wrapped`."""
    kind = F.coalesce(field("type"), field("record_type"), F.lit(""))
    return F.when(F.col("wrapped") & (kind == "response_item"), F.coalesce(field("payload.type"), F.lit(""))).otherwise(kind)


def own_words(column: str) -> Column:
    """What of a codex user's text is the user's; null of text that only tells the environment."""
    text = strip_preamble(F.col(column))
    return F.when(~F.regexp_like(text, F.lit(r"(?s)^\s*<(environment_context|cwd)>.*?</\1>\s*$")), text)


def payload_field(path: str, kind: str = "string") -> Column:
    """A field of the normalised record: of its payload where the type has one, else its own."""
    return F.when(F.col("wrapped"), field(f"payload.{path}", kind)).otherwise(field(path, kind))


#: Tables of codex records.
_CODEX = ("sessions", "tool_calls", "events", "turns")


def _codex_fields(records: DataFrame) -> DataFrame:
    """What codex records say, a column each, so that a record is gone through once; a column is null of records of other types."""
    col = F.col
    # Past an array of one the optimiser moves nothing, so these are not worked out again below.
    base = records.select("file", "seq", "v", F.explode(F.array(wrapped())).alias("wrapped"))
    base = base.select("file", "seq", "v", "wrapped", F.explode(F.array(codex_type())).alias("rtype"))
    is_meta, event, message = col("rtype") == "session_meta", col("rtype") == "event_msg", col("rtype") == "message"
    call, output = col("rtype") == "function_call", col("rtype") == "function_call_output"
    base = base.select("*", F.explode(F.array(F.struct(
        field("timestamp").alias("ts"), F.when(event, payload_field("type")).alias("kind"), F.when(message, payload_field("role")).alias("role"), F.when(is_meta | call | output, payload_field("id")).alias("id"), F.when(message, typed_blocks(payload_field, ("text", "input_text", "output_text"), bare=True)).alias("texts")))).alias("h")).select("file", "seq", "v", "wrapped", "rtype", "h.*")
    user = message & (col("role") == "user")
    started = F.coalesce(payload_field("started_at", "double"), F.try_to_number(payload_field("started_at"), F.lit("999999999999999999")).cast("double"))
    token, totals = event & (col("kind") == "token_count"), "info.total_token_usage"
    counters = F.struct(*[zero(payload_field(f"{totals}.{c}", "bigint")).alias(c) for c in usage.COUNTERS], *[payload_field(f"{totals}.{c}", "variant").isNotNull().alias(f"has_{c}") for c in usage.COUNTERS])
    raw = payload_field("arguments", "variant")
    call_id = F.coalesce(F.nullif(payload_field("call_id"), F.lit("")), col("id"))
    spawn = "source.subagent.thread_spawn"
    meta = F.struct(col("id").alias("id"), payload_field("timestamp").alias("at"), col("ts").alias("ts"), F.coalesce(*[F.nullif(payload_field(p), F.lit("")) for p in ("parent_thread_id", f"{spawn}.parent_thread_id", "forked_from_id")]).alias("parent"), zero(payload_field(f"{spawn}.depth", "int")).alias("depth"))
    cwd = F.when(col("rtype").isin("session_meta", "turn_context"), payload_field("cwd")).when(user, F.trim(F.regexp_extract(F.array_join("texts", " "), r"(?s)<cwd>(.*?)</cwd>", 1)))
    return base.select(
        "file", "seq", "rtype", "ts", "role", "texts", F.when(is_meta, col("id")).alias("id"), F.when(is_meta, payload_field("forked_from_id")).alias("forked"), F.when(event & (col("kind") == "task_started"), started).alias("started"),
        F.when(token & F.schema_of_variant(payload_field(totals, "variant")).startswith("OBJECT"), counters).alias("counters"), F.when(message & (col("role") == "assistant"), F.to_json(payload_field("content", "variant"))).alias("content"),
        F.when(call, F.struct(F.coalesce(payload_field("name"), F.lit("unknown")).alias("tool_name"), call_id.alias("call_id"), F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(payload_field("arguments"))).otherwise(raw).alias("a"))).alias("call"),
        F.when(output, F.struct(call_id.alias("call_id"), output_is_error(payload_field("output", "variant"), payload_field("output")).alias("is_error"))).alias("output"),
        F.nullif(field("id"), F.lit("")).alias("own_id"), F.nullif(cwd, F.lit("")).alias("cwd"), F.when(is_meta, meta).alias("meta"), F.when(col("rtype") == "turn_context", F.nullif(payload_field("model"), F.lit(""))).alias("model"))


def codex(records: DataFrame, wanted: tuple[str, ...] = _CODEX) -> dict[str, DataFrame]:
    """The `wanted` tables (`ids` has what a file says of its session). Records are read once; what stands in the way of one table alone
    is not written."""
    fields = staged(_codex_fields(records), "fields") if set(wanted) != {"ids"} else _codex_fields(records)
    shared = staged if len(wanted) > 1 else lambda rows, label: rows

    @functools.cache
    def rows() -> DataFrame:
        # Indexes of good records, on narrow rows.
        second = F.floor(F.unix_micros(event_time(F.col("ts"))) / F.lit(1_000_000))
        begun = F.floor(F.when(F.abs("started") >= 1e11, F.col("started") / 1000).otherwise(F.col("started")))
        narrow = fields.select("file", "seq", "rtype", "id", "forked", (begun == second).alias("boundary"))
        index = F.row_number().over(Window.partitionBy("file").orderBy("seq")) - 1
        numbered = narrow.withColumn("i", index)
        shape = numbered.groupBy("file").agg(
            F.max(F.when(F.col("i") == 0, F.col("forked"))).alias("forked"), F.max(F.when(F.col("i") == 1, F.col("id"))).alias("copied"),
            F.min_by("seq", F.when((F.col("i") >= 2) & F.col("boundary"), F.col("i"))).alias("end"), F.min("seq").alias("head"))
        # The prefix that a fork copied: what comes after its first record and before the first task that begins in its record's second.
        copied = staged(shape.filter("forked = copied and forked <> ''").select("file", "head", "end"), "copied")
        return fields.join(copied, "file", "left").withColumn("replay", F.coalesce(F.col("head").isNotNull() & (F.col("seq") > F.col("head")) & (F.col("end").isNull() | (F.col("seq") < F.col("end"))), F.lit(False))).drop("head", "end")

    def deltas() -> DataFrame:
        present = [F.col(f"counters.has_{c}") for c in usage.COUNTERS]
        tokens = rows().filter("counters is not null")
        counted = tokens.select("file", "seq", "ts", "replay", *[F.col(f"counters.{c}").alias(c) for c in usage.COUNTERS], (present[0] | present[1] | present[2] | present[3]).alias("any"), (present[0] & present[1] & present[2]).alias("all")).filter("any")
        nothing = F.col("all")
        for c in usage.COUNTERS:
            nothing = nothing & (F.col(c) == 0)
        return usage.counter_deltas(counted, ["file"], "seq", reset=nothing, replay=F.col("replay"))

    @functools.cache
    def users() -> DataFrame:
        said = rows().filter("rtype = 'message' and role = 'user'").select("file", "seq", "ts", "replay", F.explode(F.array(strip_preamble(F.array_join("texts", " ")))).alias("text"), "texts")
        context = F.regexp_like("text", F.lit(r"(?s)^\s*<(environment_context|cwd)>.*?</\1>\s*$"))
        return staged(said.withColumn("text", F.when(~context, F.col("text"))).filter(F.char_length("text") >= 3), "users")

    @functools.cache
    def replies() -> DataFrame:
        said = rows().filter("rtype = 'message' and role = 'assistant' and not replay").select("file", "seq", "ts", content_text("content").alias("text"), "texts")
        return shared(said.filter(F.trim("text") != ""), "replies")

    @functools.cache
    def results() -> DataFrame:
        return rows().filter("output is not null and not replay").select("file", "seq", "output.call_id", "output.is_error")

    def called() -> DataFrame:
        return rows().filter("call is not null and not replay").select("file", "seq", F.col("ts").alias("timestamp"), "call.*")

    @functools.cache
    def calls() -> DataFrame:
        words = F.coalesce(*[vget(F.col("a"), k, "array<string>") for k in ("command", "cmd")])
        cmd = F.when(words.isNotNull(), F.when((F.size(words) >= 3) & (F.get(words, F.lit(1)) == "-lc"), F.element_at(words, -1)).otherwise(F.array_join(words, " "))).otherwise(F.coalesce(*[F.nullif(vget(F.col("a"), k), F.lit("")) for k in ("command", "cmd")]))
        worded = _with_paths(called().select("file", F.struct("seq", F.lit(0).alias("place")).alias("seq"), "timestamp", "tool_name", "call_id", cmd.alias("command"), F.to_json("a").alias("arguments")))
        return shared(usage.attach_results(worded, results().filter("call_id is not null").select("file", "call_id", F.struct("seq", F.lit(0).alias("place")).alias("seq"), "is_error")), "calls")

    @functools.cache
    def ids() -> DataFrame:
        scalars = fields.groupBy("file").agg(
            _first(F.col("meta")).alias("m"), _first(F.col("ts")).alias("first_ts"), F.max_by("ts", F.when(F.col("ts") != "", F.col("seq"))).alias("last_timestamp"), F.min_by("own_id", "seq").alias("own_id"),
            F.coalesce(_first(F.col("cwd")), F.lit("unknown")).alias("project"), _first(event_day(F.col("ts"))).alias("fallback_day"), _first(F.col("model")).alias("model"))
        name = stem(F.col("file"))
        found = scalars.select("file", name.alias("session_id"), "project", "fallback_day", "model", F.coalesce("m.at", "m.ts", "first_ts").alias("first_timestamp"), F.coalesce("last_timestamp", "m.at").alias("last_timestamp"),
                               F.coalesce(F.nullif(F.col("m.id"), F.lit("")), "own_id", name).alias("thread_id"), F.col("m.parent").alias("parent_thread_id"), zero(F.col("m.depth")).alias("spawn_depth"))
        return shared(found, "ids")

    @functools.cache
    def events() -> DataFrame:
        d = lambda c: F.col(f"{c}_delta").cast("long")
        fresh = F.col("fresh_input_delta").cast("long")
        used = called() if len(wanted) == 1 else calls()
        return shared(
            deltas().select("file", event_day(F.col("ts")).alias("day"), fresh.alias("fresh_input_tokens"), d("cached_input_tokens").alias("cached_input_tokens"), *_blank(*MEASURES[2:6]), (fresh + d("cached_input_tokens")).alias("total_input_tokens"), d("output_tokens").alias("total_output_tokens"), d("reasoning_output_tokens").alias("reasoning_output_tokens"), *_blank(*MEASURES[9:]))
            .unionByName(users().filter("not replay").select("file", event_day(F.col("ts")).alias("day"), *_blank(*MEASURES[:9]), F.lit(1).cast("long").alias("user_message_count"), *_blank(*MEASURES[10:])))
            .unionByName(replies().select("file", event_day(F.col("ts")).alias("day"), *_blank(*MEASURES[:10]), F.lit(1).cast("long").alias("assistant_message_count"), *_blank("tool_call_count")))
            .unionByName(used.select("file", event_day(F.col("timestamp")).alias("day"), *_blank(*MEASURES[:11]), F.lit(1).cast("long").alias("tool_call_count"))), "events")

    def sessions() -> DataFrame:
        title = users().filter(~is_agents_payload(F.col("text"))).groupBy("file").agg(F.substring(F.min_by("text", "seq"), 1, 500).alias("first_user_message"))
        errors = results().groupBy("file").agg(F.sum(F.col("is_error").cast("long")).alias("error_count"))
        held = ids()
        return _sessions(held.drop("model"), events(), title, held.select("file", "model"), errors, "codex")

    def turns() -> DataFrame:
        searched = ~F.col("replay") & ~is_agents_payload(F.col("text"))
        asked = users().select("file", "seq", F.lit("user").alias("role"), "text", searched.alias("searched"), spoken(F.col("texts"), ~F.col("replay"), user=True).alias("spoken"))
        # A reply is counted and shown with all its text; searched is only what it says in blocks of text.
        said = replies().select("file", "seq", F.lit("assistant").alias("role"), "text", F.lit(True).alias("searched"), spoken(F.col("texts"), F.lit(True)).alias("spoken"))
        return _named(asked.unionByName(said), ids())

    made = {"ids": ids, "sessions": sessions, "turns": turns, "events": lambda: _named(events(), ids()), "tool_calls": lambda: _named(calls(), ids())}
    return {name: made[name]() for name in wanted}


def output_is_error(output: Column, text: Column) -> Column:
    """Whether a tool's output tells a failure: exit code, error flag, or the words of a failed process."""
    parsed = F.coalesce(F.when(F.schema_of_variant(output) == "STRING", F.try_parse_json(text)), output)
    code = F.coalesce(vget(parsed, "metadata.exit_code", "bigint"), F.lit(0)) != 0
    flag = F.coalesce(vget(parsed, "is_error", "boolean"), F.lit(False))
    shown = F.coalesce(vget(parsed, "output"), vget(parsed, "content"), text, F.lit(""))
    words = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(shown, r"Process exited with code (\d+)", 1), F.lit("")), F.lit("999999999")), F.lit(0)) != 0
    return code | flag | words
