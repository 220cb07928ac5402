"""Shell words and argument walks, for which Spark has no expression: small Arrow helpers."""

from __future__ import annotations

import json
import re
import shlex

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Argument keys that hold paths.
PATH_KEYS = ("file", "filepath", "file_path", "filename", "path", "target_file", "target_path", "old_path", "new_path", "destination", "destination_path", "include", "exclude")
PATH_LIST_KEYS = ("file_paths", "files", "filenames", "paths", "targets")
CONTROL = ("&&", "||", "|", ";", ">", ">>", "<", "2>", "2>>", "1>", "1>>")
WORDS = T.ArrayType(T.StringType())


def split_words(command: str | None) -> list[str]:
    """Shell words; a command with unbalanced quotes is split at white space."""
    try:
        return shlex.split(command or "")
    except ValueError:
        return (command or "").split()


@F.arrow_udf(WORDS)
def shell_words(commands: pa.Array) -> pa.Array:
    return pa.array([split_words(c) for c in commands.to_pylist()], pa.list_(pa.string()))


def named_values(node, key: str = "") -> list[str]:
    """Strings below keys that name paths, in document order."""
    if isinstance(node, dict):
        out = []
        for k, value in node.items():
            name = k.strip().lower()
            if isinstance(value, str):
                out += [value] if name in PATH_KEYS + PATH_LIST_KEYS or re.search(r"(_path|_file|_files)$", name) else []
            else:
                out += named_values(value, name)
        return out
    if isinstance(node, list):
        return [x for item in node for x in ([item] if isinstance(item, str) and key in PATH_LIST_KEYS else named_values(item, key) if isinstance(item, dict) else [])]
    return []


@F.arrow_udf(WORDS)
def argument_values(arguments: pa.Array) -> pa.Array:
    """Path-like arguments of JSON objects, before they are tested for looking like paths."""
    def of(text):
        try:
            return named_values(json.loads(text)) if text else []
        except ValueError:
            return []
    return pa.array([of(t) for t in arguments.to_pylist()], pa.list_(pa.string()))


def joined_text(node) -> str:
    """All text below a content node: strings, and the text, thinking and content fields of objects."""
    if isinstance(node, str):
        return node
    if isinstance(node, dict):
        return next((t for t in (joined_text(node[k]) for k in ("text", "thinking", "content") if k in node) if t), "")
    if isinstance(node, list):
        return " ".join(t for t in map(joined_text, node) if t)
    return ""


@F.arrow_udf(T.StringType())
def content_text(contents: pa.Array) -> pa.Array:
    def of(text):
        try:
            return joined_text(json.loads(text)) if text else ""
        except ValueError:
            return ""
    return pa.array([of(t) for t in contents.to_pylist()], pa.string())


FRAGMENTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("role", "tool_name", "text")]))
#: Blocks by type: role of the fragment, and the fields that hold what was said, first to last.
TOOL_BLOCKS = {"tool_use": ("tool_use", ("input", "arguments")), "function_call": ("tool_use", ("input", "arguments")),
               "tool_result": ("tool_result", ("content", "output")), "function_call_output": ("tool_result", ("content", "output"))}


def compact(node) -> str:
    return json.dumps(node, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def content_pieces(node, role: str | None, kind: str | None) -> list[tuple[str | None, str | None, str]]:
    """(role, tool name, text) of message content of a record of type `kind`, in document order, without empty ones."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, list):
            todo += reversed(at)
        elif isinstance(at, dict) and (at.get("type") or kind) in TOOL_BLOCKS:
            name, fields = TOOL_BLOCKS[at.get("type") or kind]
            said = next((at[f] for f in fields if f in at), at)
            if name == "tool_use" or isinstance(said, dict):
                said = compact(said)
            elif not isinstance(said, str):
                said = joined_text(said) or compact(said)
            out.append((name, at.get("name") if name == "tool_use" else None, said))
        elif isinstance(at, dict) and "content" in at and not {"text", "thinking"} & at.keys():
            todo.append(at["content"])
        elif isinstance(at, dict):
            said = next((at[f] or "" for f in ("text", "thinking") if f in at), None)
            out.append((role, None, joined_text(at) if said is None else str(said)))
        elif at is not None:
            out.append((role, None, str(at)))
    return [(r, None if n is None else str(n), t) for r, n, t in ((r, n, t.replace("\0", "").strip()) for r, n, t in out) if t]


@F.arrow_udf(FRAGMENTS)
def content_fragments(contents: pa.Array, roles: pa.Array, kinds: pa.Array) -> pa.Array:
    rows = zip(contents.to_pylist(), roles.to_pylist(), kinds.to_pylist())
    names = FRAGMENTS.elementType.names
    found = [[dict(zip(names, x)) for x in content_pieces(json.loads(c), r, k)] if c else [] for c, r, k in rows]
    return pa.array(found, pa.list_(pa.struct([(n, pa.string()) for n in names])))
