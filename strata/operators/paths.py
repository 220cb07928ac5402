"""Paths that tool calls touch: from arguments and shell words to normalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.classify import clean_path, looks_like_path
from strata.functions.words import CONTROL, argument_values, shell_words


def argument_paths(arguments: Column) -> Column:
    """Paths among a call's arguments (JSON text), cleaned, in order, each once."""
    return F.array_distinct(F.transform(F.filter(argument_values(arguments), looks_like_path), clean_path))


def command_paths(command: Column) -> Column:
    """Paths among the words after a command's first; no options, no control words."""
    words = shell_words(command)
    rest = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), clean_path)
    return F.array_distinct(F.filter(rest, lambda w: ~w.isin(*CONTROL) & looks_like_path(w)))


def first_word(command: Column) -> Column:
    """The command's first shell word without folders."""
    return F.regexp_extract(F.coalesce(F.get(shell_words(command), F.lit(0)), F.lit("")), r"([^/]*)/*$", 1)


def home_expanded(path: Column, home: Column) -> Column:
    return F.when(F.regexp_like(path, F.lit(r"^~(?:/|$)")), F.concat(home, F.substring(path, F.lit(2), F.char_length(path)))).otherwise(path)


def tidy(path: Column) -> Column:
    """Without doubled slashes, single dots and a trailing slash."""
    out = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/(?:\./)+", "/")
    return F.regexp_replace(F.regexp_replace(out, r"/\.$", ""), r"^\./|(?<=.)/$", "")


def normalized(path: Column, root: Column, home: Column) -> Column:
    """struct(normalized_path, relative_path, display_path) of a cleaned path in a workspace."""
    known = F.when((root != "") & (root != "unknown"), tidy(home_expanded(root, home)))
    bare = tidy(home_expanded(path, home))
    absolute = bare.startswith("/")
    full = F.when(absolute | known.isNull(), bare).otherwise(tidy(F.concat(known, F.lit("/"), bare)))
    inside = known.isNotNull() & full.startswith(F.concat(known, F.lit("/")))
    relative = F.when(inside, F.substring(full, F.char_length(known) + 2, F.char_length(full)))
    tail = F.regexp_extract(full, r"([^/]+(?:/[^/]+)?)$", 1)
    short = F.when(full.startswith("/"), F.concat(F.lit("…/"), tail)).otherwise(path)
    return F.struct(full.alias("normalized_path"), relative.alias("relative_path"), F.coalesce(relative, short).alias("display_path"))


def session_paths(calls: DataFrame, home: str = "/home/user") -> DataFrame:
    """Path uses of tool calls (session_id, seq, tool_name, operation, timestamp, workspace_root, input_paths,
    command_paths), in order of use."""
    both = F.concat(
        F.transform("input_paths", lambda p: F.struct(F.lit("tool_input").alias("source"), p.alias("raw_path"))),
        F.transform("command_paths", lambda p: F.struct(F.lit("command").alias("source"), p.alias("raw_path"))))
    rows = calls.select("session_id", "seq", "tool_name", "operation", "timestamp", "workspace_root", F.posexplode(both).alias("place", "p"))
    form = normalized(F.col("p.raw_path"), F.coalesce("workspace_root", F.lit("")), F.lit(home))
    return rows.select("session_id", F.struct("seq", "place").alias("seq"), "tool_name", "operation", "timestamp", "p.source", "p.raw_path", form.alias("n")).select("*", "n.*").drop("n")


def repo_relative(path: Column, repo_root: Column) -> Column:
    """A normalised path below its repository's root, null outside."""
    root = tidy(repo_root)
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.char_length(root) + 2, F.char_length(path)))
