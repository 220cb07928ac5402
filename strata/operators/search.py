"""Ranked phrase search over structured fields and transcript text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import clean_search_text, title_text, tokens, windows
from strata.sources.store import Store, staged

# Structured fields of a session and their labels, ranked before transcript text.
STRUCTURED = (("session_goal", "goal"), ("session_summary", "summary"), ("first_user_message", "title"), ("repo_name", "repo"), ("project", "project"))
TITLES = ("session_goal", "first_user_message")
# BM25 parameters.
K1, B = 1.2, 0.75
VERSION = 7


def metadata_hash(sessions: DataFrame) -> Column:
    """SHA-256 of the length-prefixed labels and texts of the structured fields."""
    parts = [F.concat(F.lit(f"{len(label)}:{label}"), F.char_length(F.coalesce(F.col(c), F.lit(""))), F.lit(":"), F.coalesce(F.col(c), F.lit(""))) for c, label in STRUCTURED if c in sessions.columns]
    return F.sha2(F.concat(*parts), 256)


def documents(sessions: DataFrame, turns: DataFrame, chunk: int = 12_000, overlap: int = 400) -> DataFrame:
    """session_id, field_label, chunk_index, tier, text: structured fields (tier 0) and cleaned transcript windows (tier 1) of each
    text that a turn speaks (`spoken`, or its whole text where the turns have no such column)."""
    fields = F.array(*[F.struct(F.lit(label).alias("field_label"), (title_text(F.col(c)) if c in TITLES else F.col(c)).alias("text")) for c, label in STRUCTURED if c in sessions.columns])
    structured = sessions.select("session_id", F.explode(fields).alias("f")).select("session_id", "f.field_label", F.lit(0).alias("chunk_index"), F.lit(0).alias("tier"), F.trim("f.text").alias("text")).filter("text <> ''")
    own = F.col("spoken") if "spoken" in turns.columns else F.array("text")
    said = turns.filter("searched").select("session_id", "role", "seq", F.posexplode(own).alias("block", "text")).withColumn("text", clean_search_text(F.col("text"))).filter("text <> ''")
    number = F.row_number().over(Window.partitionBy("session_id", "role").orderBy("seq", "block"))
    cut = said.withColumn("turn", number).select("session_id", "role", "turn", F.explode(windows(F.col("text"), chunk, overlap)).alias("w"))
    transcript = cut.select("session_id", F.concat("role", F.lit(":"), "turn").alias("field_label"), F.col("w.chunk_index").alias("chunk_index"), F.lit(1).alias("tier"), F.col("w.chunk").alias("text"))
    return structured.unionByName(transcript)


def indexed(docs: DataFrame, id_columns: tuple[str, ...], text: str = "text", fold: bool = True) -> DataFrame:
    """Documents with their tokens, as ' a b c ', and their number."""
    words = tokens(F.col(text), fold)
    return docs.select(*id_columns, *[c for c in docs.columns if c not in id_columns and c != text], words.alias("words")).withColumn("n_words", F.size("words")).withColumn("stream", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).drop("words")


def query_tokens(query: str) -> list[str]:
    """Tokens of a query; all together are one phrase."""
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return [t for t in re.split(r"[\W_]+", folded) if t]


def phrase_count(stream: Column, words: list[str]) -> Column:
    """Occurrences of the phrase in a token stream; they may share their end words."""
    quoted = r"\Q" + " ".join(words) + r"\E"
    return F.regexp_count(stream, F.lit(rf"(?<= ){quoted}(?= )"))


def bm25() -> Column:
    """Score of a row with tf, n_words, docs, mean_words and hits."""
    idf = F.log((F.col("docs") - F.col("hits") + 0.5) / (F.col("hits") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    length = 1 - B + B * F.col("n_words") / F.col("mean_words")
    return -idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)


def scored(index: DataFrame, query: str) -> DataFrame:
    """Documents with the phrase and their BM25 score (negative, least best) over the whole index."""
    words = query_tokens(query)
    if not words:
        return index.limit(0).withColumn("score", F.lit(0.0))
    counted = index.withColumn("tf", phrase_count(F.col("stream"), words))
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n_words").alias("mean_words"), F.sum((F.col("tf") > 0).cast("long")).alias("hits"))
    return counted.filter("tf > 0").join(F.broadcast(stats)).withColumn("score", bm25()).drop("docs", "mean_words", "hits")


def _runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of lists with about `most` entries, at least one list each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        yield i, j
        i = j


def _placed(ids: tuple[str, ...], most: int = 1 << 17):
    """Places of each token of each document. Documents are gone through in runs of about `most` words, so that a worker holds the arrays
    of one run (a document at least) besides the batch, and gives their memory back."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in _runs(whole.column("words").offsets.to_numpy(), most):
                yield placed(whole.slice(i, j - i))
                pa.default_memory_pool().release_unused()

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("words")
        coded = words.flatten().dictionary_encode()
        codes, sizes = coded.indices.to_numpy(), np.diff(words.offsets.to_numpy())
        owner, begin = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((codes, owner))
        code, own = codes[order], owner[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (own[1:] != own[:-1]))) if len(code) else np.zeros(0, np.int64)
        places = (np.arange(len(codes)) - begin)[order].astype(np.int32)
        at = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(places))
        of = pa.array(own[first])
        columns = [coded.dictionary.take(pa.array(code[first])), *[batch.column(c).take(of) for c in ids], pa.array(sizes[own[first]].astype(np.int32)), at]
        return pa.RecordBatch.from_arrays(columns, ["token", *ids, "n_words", "at"])
    return rows


def postings(docs: DataFrame, id_columns: tuple[str, ...], text: str = "text", fold: bool = True) -> DataFrame:
    """token, the id columns, n_words, at (places of the token in order), sorted by token in each file: a query for a few tokens reads their
    pages alone. Places are gathered inside each document, so one row a token and document is moved, once. Adaptive execution cuts parts
    that grow large, a hot token's too, so that a task sorts as much whatever there is; a range of tokens would need a pass to sample them
    and a written table for it, and a set number of parts."""
    held = docs.select(*id_columns, tokens(F.col(text), fold).alias("words"))
    fields = [T.StructField("token", T.StringType()), *[docs.schema[c] for c in id_columns], T.StructField("n_words", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType()))]
    placed = held.mapInArrow(_placed(tuple(id_columns)), T.StructType(fields))
    return placed.hint("rebalance", "token").sortWithinPartitions("token", *id_columns)


def index_stats(docs: DataFrame, text: str = "text", fold: bool = True) -> DataFrame:
    """docs, mean_words: one row about the whole index."""
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size(tokens(F.col(text), fold))).alias("mean_words"))


def matched(index: DataFrame, words: list[str], id_columns: tuple[str, ...]) -> DataFrame:
    """The id columns, n_words, tf of documents with the phrase, from the postings of its tokens alone."""
    numbers = {w: [i for i, x in enumerate(words) if x == w] for w in words}
    hits = index.filter(F.col("token").isin(list(numbers)))
    if len(words) == 1:
        return hits.select(*id_columns, "n_words", F.size("at").alias("tf"))
    offsets = F.create_map(*[c for w, at in numbers.items() for c in (F.lit(w), F.array(*[F.lit(i) for i in at]))])
    starts = hits.select(*id_columns, "n_words", "at", F.explode(offsets[F.col("token")]).alias("i")).select(*id_columns, "n_words", F.transform("at", lambda p: p - F.col("i")).alias("starts"))
    met = starts.groupBy(*id_columns, "n_words").agg(F.collect_list("starts").alias("all")).filter(F.size("all") == len(words))
    both = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return met.select(*id_columns, "n_words", F.size(both).alias("tf")).filter("tf > 0")


def scored_postings(index: DataFrame, stats: DataFrame, query: str, id_columns: tuple[str, ...]) -> DataFrame:
    """As `scored`, from postings and the index's stats: documents without a token of the query are not read."""
    words = query_tokens(query)
    if not words:
        return index.limit(0).select(*id_columns, "n_words", F.lit(0).alias("tf"), F.lit(0.0).alias("score"))
    hits = matched(index, words, id_columns)
    number = hits.agg(F.count(F.lit(1)).alias("hits"))
    rows = hits.join(F.broadcast(stats)).join(F.broadcast(number))
    return rows.withColumn("score", bm25()).drop("docs", "mean_words", "hits")


def eligible(states: DataFrame, sessions: DataFrame, public: bool = False) -> DataFrame:
    """Sessions whose index is current: version, file hash and status; in public mode also the reviewed ones."""
    held = sessions.join(states, "session_id")
    good = (F.col("index_version") == VERSION) & (F.col("status") == "ok") & F.col("indexed_hash").eqNullSafe(F.col("file_hash"))
    if public:
        good = good & F.col("direct_public") & F.col("reviewed_hash").eqNullSafe(F.col("file_hash")) & F.col("reviewed_metadata_hash").eqNullSafe(F.col("metadata_hash"))
    return held.filter(good).select("session_id")


def best(hits: DataFrame, key: str, *order: Column) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def snippet(stream: Column, words: list[str], width: int = 28) -> Column:
    """Tokens around the first hit, the hit in brackets."""
    all_ = F.split(F.trim(stream), " ")
    before = F.size(F.filter(F.split(F.substring_index(stream, f" {' '.join(words)} ", 1), " "), lambda w: w != ""))
    start = F.greatest(F.lit(0), before - F.lit((width - len(words)) // 2))
    left, right = F.slice(all_, start + 1, before - start), F.slice(all_, before + 1 + len(words), F.lit(max(0, width - len(words))) - (before - start))
    lead, tail = F.when(start > 0, F.lit("… ")).otherwise(""), F.when(F.size(all_) > start + width, F.lit(" …")).otherwise("")
    return F.concat(lead, F.concat_ws(" ", F.array_join(left, " "), F.lit(f"[{' '.join(words)}]"), F.array_join(right, " ")), tail)


DOC = ("session_id", "field_label", "chunk_index", "tier")


def search(index: DataFrame, sessions: DataFrame, query: str, allowed: DataFrame | None = None, limit: int = 20, public: bool = False, held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Best document of each session: structured before transcript, then score, newest, id.

    Scores count the whole index, results only the allowed sessions; public results hide the score. With `held`, the
    postings and stats of the index, only what the query's tokens name is read, and `index` for the snippets alone.
    """
    hits = scored(index, query) if held is None else scored_postings(*held, query, DOC)
    if allowed is not None:
        hits = hits.join(allowed.select("session_id"), "session_id", "left_semi")
    one = best(hits, "session_id", F.col("tier"), F.col("score"), F.col("field_label"), F.col("chunk_index"))
    top = one.join(sessions.select("session_id", "first_timestamp"), "session_id").orderBy("tier", "score", F.desc_nulls_last("first_timestamp"), "session_id").limit(limit)
    if held is not None:
        ids = [r[0] for r in top.select("session_id").collect()]  # at most `limit`
        top = top.join(index.filter(F.col("session_id").isin(ids)).select(*DOC, "stream"), list(DOC)).orderBy("tier", "score", F.desc_nulls_last("first_timestamp"), "session_id")
    shown = F.lit(None).cast("double") if public else F.col("score")
    return top.select("session_id", "tier", "field_label", "chunk_index", snippet(F.col("stream"), query_tokens(query)).alias("snippet"), shown.alias("score"), "first_timestamp")


def raw_search(lines: DataFrame, text: str) -> DataFrame:
    """First line of each file that holds the text, case aside."""
    hit = lines.filter(F.lower("value").contains(text.lower()))
    return hit.groupBy("file").agg(F.min_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("lines"))


def excerpt(text: Column, words: str, around: int = 90) -> Column:
    """The text around the first place of the words, case aside."""
    at = F.greatest(F.instr(F.lower(text), words.lower()) - around, F.lit(1))
    return F.trim(F.regexp_replace(F.substring(text, at, F.lit(2 * around + len(words))), r"\s+", " "))


def forensic(sessions: DataFrame, calls: DataFrame, lines: DataFrame, words: str, limit: int | None = 20, public: bool = False) -> DataFrame:
    """session_id, role, event_index, excerpt: sessions whose metadata or tool calls hold the words, newest first, then those with a raw
    line that does (its number counts from 1). `lines` has file, seq and value; `sessions` the file of each."""
    may = sessions.filter("listed_public") if public else sessions
    like = lambda c: F.col(c).ilike(f"%{words}%")
    used = calls.filter(like("command") | like("tool_name")).select("session_id").distinct().withColumn("_used", F.lit(True))
    told = may.join(used, "session_id", "left")
    meta = told.filter(F.coalesce(like("first_user_message"), F.lit(False)) | F.coalesce(like("session_goal"), F.lit(False)) | F.coalesce(like("session_summary"), F.lit(False)) | F.col("_used"))
    text = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("first_user_message", "session_goal", "session_summary")], F.lit(""))
    rows = meta.select("session_id", "first_timestamp", F.lit("metadata").alias("role"), F.lit(None).cast("long").alias("event_index"), excerpt(text, words).alias("excerpt"))
    # Numbers of lines are counted in files with a hit alone, on rows without text.
    hits = lines.filter(F.lower("value").contains(words.lower())).groupBy("file").agg(F.min_by(F.struct("seq", "value"), "seq").alias("hit"))
    hits = staged(hits.join(may.join(meta.select("session_id"), "session_id", "left_anti").select("file", "session_id", "first_timestamp"), "file"), "hits")
    before = lines.select("file", "seq").join(hits.select("file", F.col("hit.seq").alias("at")), "file").filter(F.col("seq") <= F.col("at")).groupBy("file").agg(F.count(F.lit(1)).alias("event_index"))
    raw = hits.join(before, "file").select("session_id", "first_timestamp", F.lit("raw").alias("role"), "event_index", excerpt(F.col("hit.value"), words).alias("excerpt"))
    both = rows.unionByName(raw).orderBy("role", F.desc_nulls_last("first_timestamp"), "session_id")
    return both if limit is None else both.limit(limit)


def chunk_search(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Archive search: chunks with every word, tool results aside, by word density; with no hit, chunks
    that hold the query as it stands, tool results included, ranked 0."""
    words = query_tokens(query)
    stream = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    rows = chunks.withColumn("stream", stream)
    every, density = F.col("kind") != "tool_result", F.lit(0)
    for w in words:
        every = every & F.col("stream").contains(f" {w} ")
        density = density + phrase_count(F.col("stream"), [w])
    ranked = rows.filter(every).withColumn("rank", density / (1.0 + F.size(F.split(F.trim("stream"), " "))))
    plain = rows.filter(F.col("text").ilike(f"%{query}%")).withColumn("rank", F.lit(0.0))
    some = ranked.agg((F.count(F.lit(1)) > 0).alias("some"))
    both = ranked.unionByName(plain.join(F.broadcast(some)).filter("not some").drop("some"))
    return both.drop("stream").orderBy(F.desc("rank"), "file_id", "event_index", "chunk_index").limit(limit)


def to_index(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """Sessions without a current index."""
    current = states.filter((F.col("index_version") == VERSION) & (F.col("status") == "ok")).select(F.col("session_id").alias("s"), F.col("indexed_hash").alias("h"))
    return sessions.join(current, (F.col("session_id") == F.col("s")) & F.col("file_hash").eqNullSafe(F.col("h")), "left_anti")


def orphans(index: DataFrame, sessions: DataFrame) -> DataFrame:
    return index.join(sessions.select("session_id"), "session_id", "left_anti")


#: Tables of the index, each of segments by session.
INDEX_TABLES = ("search_index", "search_postings", "search_sizes")
STATE = "session_id string, indexed_hash string, index_version int, status string"


def stamped(sessions: DataFrame) -> DataFrame:
    """Sessions whose hash covers all that is indexed: the transcript and the structured fields."""
    return sessions.withColumn("file_hash", F.concat_ws("/", "file_hash", "metadata_hash"))


def index_batch(store: Store, sessions: DataFrame, turns: DataFrame) -> None:
    """Append one segment: documents, postings and sizes of these sessions in place of what the index has of them, and their
    states, all at once. A session without documents has a state alone."""
    docs = staged(documents(sessions, turns.join(sessions.select("session_id"), "session_id", "left_semi")), "search_documents")
    touched = staged(sessions.select("session_id", "file_hash"), "touched")
    index = staged(indexed(docs, DOC), "indexed")
    sizes = index.groupBy("session_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").cast("long").alias("words"))
    states = touched.select("session_id", F.col("file_hash").alias("indexed_hash"), F.lit(VERSION).alias("index_version"), F.lit("ok").alias("status"))
    with store.batch():
        for name, rows in zip(INDEX_TABLES, (index.repartitionByRange("session_id").sortWithinPartitions("session_id"), postings(docs, DOC), sizes)):
            store.replace(name, rows, touched)
        store.replace("search_states", states, touched)


def refresh_index(store: Store, sessions: DataFrame, turns: DataFrame, batch: int = 20_000) -> int:
    """Bring the index up to date, `batch` sessions at a time; each batch stands when it is written, so a run that breaks off goes on
    where it was. Sessions that are gone lose their rows. Tells how many sessions were indexed."""
    sessions = stamped(sessions)
    gone = staged(orphans(store.read("search_states", STATE), sessions).select("session_id"), "gone")
    if not gone.isEmpty():
        with store.batch():
            for name in (*INDEX_TABLES, "search_states"):
                store.replace(name, store.read(name).limit(0), gone)
    due = staged(to_index(sessions, store.read("search_states", STATE)).select("session_id"), "due")
    total = due.count()
    slots = max(1, -(-total // batch))
    for k in range(slots if total else 0):
        part = due.filter(F.pmod(F.xxhash64("session_id"), F.lit(slots)) == k) if slots > 1 else due
        index_batch(store, staged(sessions.join(part, "session_id", "left_semi"), "batch"), turns)
    return total


def summed_sizes(sizes: DataFrame) -> DataFrame:
    """docs, mean_words of the whole index, from its sessions' sums."""
    return sizes.agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("mean_words"))
