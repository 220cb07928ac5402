"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, neighbours of one role are merged, and the
pieces are concatenated as `<|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>`. Control strings
inside roles and texts are escaped with a backslash, so `parse` gives the turns back exactly.

Cases: null text or role counts as empty; null turns come first; turns that tie are ordered by role,
then text; repeated rows stay as further turns; a null conversation id is a conversation of its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import let, scanned

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: Marks of this and of other public templates, as look-aheads after the first character.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end: code points of `formatted`, end
    exclusive; first_byte, last_byte: the same in bytes of UTF-8).

    Spans cover the texts of the roles in `learn`, one span for each turn. Time follows the turns in proportion.
    """
    empty = F.lit("")
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    sorted_turns = turns.select(F.col(conv).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Where a run of one role begins, and the runs themselves.
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    bounded = sorted_turns.withColumn("begins", begins).withColumn("ends", F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("turns"))))
    run = F.zip_with("begins", "ends", lambda b, e: F.struct(
        F.get("turns", b)["role"].alias("role"),
        F.transform(F.slice("turns", b + 1, e - b), lambda t: escape(t["text"])).alias("texts")))
    runs = bounded.select("conv_id", run.alias("runs"))
    body = F.transform("runs", lambda r: F.concat(F.lit(START), escape(r["role"]), F.lit(SEP), F.array_join(r["texts"], NEXT), F.lit(END)))
    # Every text as (what stands before it since the last text, its size, what stands after), in code points and bytes.
    head = len(START) + len(SEP)
    marks = F.flatten(F.transform("runs", lambda r: let(escape(r["role"]), lambda role: F.transform(r["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.char_length(role) + head).otherwise(len(NEXT)).cast("long").alias("chars_before"),
        F.when(i == 0, F.octet_length(role) + head).otherwise(len(NEXT)).cast("long").alias("bytes_before"),
        F.char_length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"),
        F.when(i == F.size(r["texts"]) - 1, len(END)).otherwise(0).cast("long").alias("after"),
        r["role"].isin(*learn).alias("learn"))))))

    def spans(marks: Column) -> Column:
        add = lambda a, x: F.struct((a["chars"] + x["chars"]).alias("chars"), (a["bytes"] + x["bytes"]).alias("bytes"))
        steps = F.transform(marks, lambda m: F.struct((m["chars_before"] + m["chars"] + m["after"]).alias("chars"), (m["bytes_before"] + m["bytes"] + m["after"]).alias("bytes")))
        zero = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("bytes"))
        placed = F.zip_with(marks, scanned(steps, zero, add), lambda m, t: F.struct(
            (t["chars"] - m["after"] - m["chars"]).alias("start"), (t["chars"] - m["after"]).alias("end"),
            (t["bytes"] - m["after"] - m["bytes"]).alias("first_byte"), (t["bytes"] - m["after"]).alias("last_byte"), m["learn"].alias("learn")))
        return F.transform(F.filter(placed, lambda s: s["learn"]), lambda s: F.struct(*[s[c].cast("int").alias(c) for c in ("start", "end", "first_byte", "last_byte")]))

    return runs.select("conv_id", F.array_join(body, "").alias("formatted"), let(marks, spans).alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """The turns and learnt texts read back from `formatted` and `loss_spans` alone."""
    runs = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>")))
    parts = F.transform(runs, lambda r: F.split(F.substring(r, F.lit(1), F.char_length(r) - len(END)), r"<\|im_sep\|>"))
    turns = F.flatten(F.transform(parts, lambda p: F.transform(F.split(F.get(p, F.lit(1)), r"<\|im_next\|>"), lambda t: F.struct(
        unescape(F.get(p, F.lit(0))).alias("role"), unescape(t).alias("text")))))
    # Bytes are cut at once; a cut at a code point would count from the start each time.
    cut = lambda held, s: unescape(F.substring(held, s["first_byte"] + 1, s["last_byte"] - s["first_byte"]).cast("string"))
    learnt = let(F.col("formatted").cast("binary"), lambda held: F.transform("loss_spans", lambda s: cut(held, s)))
    return formatted.withColumn("turns", turns).withColumn("learnt", F.array_join(learnt, ""))


def digest(formatted: DataFrame) -> DataFrame:
    """The query's columns, all read back from the formatted text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
