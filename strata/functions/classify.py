"""Classification of sessions, commands and messages as Column expressions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session classes in report order.
PATTERNS = ("subagent", "marathon", "heavy-tooling", "long-conversation", "medium-conversation", "short-task")

# Command categories and their prefixes; the first that fits counts.
COMMAND_CATEGORIES = {
    "pr-ops": ("gh pr",),
    "git": ("git ",),
    "testing": ("pytest", "test"),
    "search": ("grep", "find", "rg"),
    "python": ("python", "uv "),
    "review": ("review", "approve"),
    "lint": ("ruff", "lint"),
    "js": ("bun", "npm"),
    "file-read": ("cat", "head", "tail", "nl", "sed"),
}

# Parts of tool names, and command words, by operation.
TOOL_WORDS = {
    "write": ("edit", "write", "replace", "patch", "apply", "create", "delete", "rename", "move"),
    "read": ("read", "open", "view", "load", "cat"),
    "search": ("search", "find", "grep", "glob", "list", "ls", "scan"),
    "shell": ("bash", "shell", "exec", "terminal", "command"),
}
COMMAND_WORDS = {
    "search": ("rg", "grep", "fd", "find", "ls", "tree", "git"),
    "read": ("cat", "bat", "sed", "head", "tail"),
    "write": ("mv", "cp", "rm", "touch", "mkdir", "tee", "apply_patch", "prettier", "black", "isort", "gofmt", "rustfmt", "clang-format", "stylua"),
}

# Session origins and what tells them.
ORIGINS = ("human_direct", "human_delegated", "system_generated", "pipeline_eval", "meta_scaffolding")
META_PREFIXES = (
    "warmup",
    "[suggestion mode:",
    "this session is being continued from a previous conversation",
    "your task is to create a detailed summary of the conversation so far",
    "<local-command-caveat>",
    "<system-reminder>",
)
PIPELINE_MARKERS = (
    "you are a senior statutory-fidelity reviewer for rac",
    "review this rac file for:",
    "you are participating in an encoding eval",
    "# rac encoder",
    "/tmp/autorac",
    "_eval_workspaces",
    "autorac-",
)
DELEGATED_MARKERS = (
    "<teammate-message",
    '"type":"task_assignment"',
    '"type": "task_assignment"',
    '"type":"shutdown_request"',
    '"type": "shutdown_request"',
    "status check",
)

# Patterns of commands that run checks.
CHECKS = {
    "test": (
        r"\b(pytest|py\.test|vitest|jest|nosetests|rspec)\b",
        r"\bpython(?:\d+(?:\.\d+)?)?\s+-m\s+(pytest|unittest)\b",
        r"\b(go|deno|mix)\s+test\b",
        r"\bcargo\s+test\b",
        r"\b(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?test\b",
        r"\buv\s+run\s+pytest\b",
    ),
    "lint": (
        r"\b(?:ruff(?:\s+check)?|flake8|pylint|eslint|shellcheck|hadolint|mypy|pyright)\b",
        r"\bbiome\s+check\b",
        r"\bgolangci-lint\b",
        r"\btsc\b.*--noemit\b",
        r"\b(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?lint\b",
    ),
    "build": (
        r"\b(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?build\b",
        r"\b(?:next|vite|webpack|rollup|parcel)\s+build\b",
        r"\bcargo\s+build\b",
        r"\bgo\s+build\b",
        r"\bpython(?:\d+(?:\.\d+)?)?\s+-m\s+build\b",
        r"\btsc\b(?!.*--noemit\b)",
    ),
    "format": (
        r"\b(?:prettier|black|isort|gofmt|rustfmt|clang-format|stylua)\b",
        r"\bruff\s+format\b",
        r"\bbiome\s+format\b",
        r"\b(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?format\b",
    ),
}

# File names without an extension that are paths.
COMMON_FILES = ("makefile", "dockerfile", "package.json", "package-lock.json", "bun.lock", "bun.lockb", "pnpm-lock.yaml", "yarn.lock", "tsconfig.json", "readme.md")


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def squeeze(text: Column) -> Column:
    """Trimmed, with every run of white space one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def session_pattern(depth: Column, users: Column, tools: Column, subagent: Column) -> Column:
    users, tools = zero(users), zero(tools)
    return (
        F.when((zero(depth) > 0) | F.coalesce(subagent, F.lit(False)), "subagent")
        .when(users > 100, "marathon")
        .when(tools > 500, "heavy-tooling")
        .when((users >= 20) & (users <= 100), "long-conversation")
        .when((users >= 5) & (users <= 19), "medium-conversation")
        .otherwise("short-task")
    )


def is_subagent(depth: Column, source: Column, parent: Column, path: Column) -> Column:
    """Spawned, or a claudecode session with a parent or under a subagents folder."""
    slashed = F.concat(F.lit("/"), F.translate(F.coalesce(path, F.lit("")), "\\", "/"), F.lit("/"))
    named = F.trim(F.coalesce(parent, F.lit(""))) != ""
    return (zero(depth) > 0) | F.coalesce((source == "claudecode") & (named | slashed.contains("/subagents/")), F.lit(False))


def command_category(command: Column) -> Column:
    low = F.lower(F.coalesce(command, F.lit("")))
    out = F.lit("other")
    for name, prefixes in reversed(COMMAND_CATEGORIES.items()):
        out = F.when(any_of(low.startswith(p) | low.contains(f" {p}") for p in prefixes), name).otherwise(out)
    return out


def operation(tool: Column, command: Column, word: Column | None = None) -> Column:
    """write, read, search, command or other. `word` is the command's first shell word, without folders;
    where it is not given the text up to the first white space counts."""
    low, typed = F.lower(F.coalesce(tool, F.lit(""))), F.lower(F.coalesce(command, F.lit("")))
    word = F.regexp_extract(F.coalesce(command, F.lit("")), r"^\s*(?:\S*/)?([^\s/]+)", 1) if word is None else word
    shell = F.lit("command")
    shell = F.when(typed.contains("ruff format") | typed.contains("biome format"), "write").otherwise(shell)
    for name in ("write", "read", "search"):
        shell = F.when(word.isin(*COMMAND_WORDS[name]), name).otherwise(shell)
    out = F.when(any_of(low.contains(w) for w in TOOL_WORDS["shell"]), shell).otherwise("other")
    for name in ("search", "read", "write"):
        out = F.when(any_of(low.contains(w) for w in TOOL_WORDS[name]), name).otherwise(out)
    return out


def runs_check(command: Column, kind: str) -> Column:
    """Whether a command runs tests, linters, builds or formatters."""
    low = F.lower(F.trim(F.coalesce(command, F.lit(""))))
    return any_of(F.regexp_like(low, F.lit(p)) for p in CHECKS[kind])


def session_status(made_changes: Column, passed_checks: Column, failures: Column) -> Column:
    good = made_changes | passed_checks
    return F.when(failures, F.when(good, "partial").otherwise("failed")).otherwise(F.when(good, "success").otherwise("exploration"))


def session_origin(message: Column, session_id: Column, *context: Column) -> Column:
    """Ordered rules over the first message and what else is known of the session."""
    said = F.lower(squeeze(message))
    around = F.lower(squeeze(F.concat_ws(" ", *[F.when(c != "", c) for c in (message, *context, session_id)])))
    agent = F.coalesce(session_id.startswith("agent-"), F.lit(False))
    return (
        F.when(any_of(said.startswith(p) for p in META_PREFIXES), "meta_scaffolding")
        .when(any_of(around.contains(m) for m in PIPELINE_MARKERS), "pipeline_eval")
        .when(agent | any_of(said.contains(m) for m in DELEGATED_MARKERS), "human_delegated")
        .when(said == "", "system_generated")
        .when(said.startswith("# agents.md instructions for "), "system_generated")
        .otherwise("human_direct")
    )


def first_line(text: Column) -> Column:
    """The first line with other than white space, trimmed; empty if none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)^\s*(\S(?:[^\n\r]*\S)?)", 1)


def objective_seed(goal: Column, message: Column, summary: Column) -> Column:
    return F.coalesce(*[F.nullif(first_line(c), F.lit("")) for c in (goal, message, summary)], F.lit(""))


def objective_family(text: Column) -> Column:
    """Lower-cased first line with code, addresses, paths, ids and numbers as placeholders; null if empty."""
    out = F.lower(first_line(text))
    for pattern, put in (
        (r"`[^`]+`", " <code> "),
        (r"https?://\S+", " <url> "),
        (r"(?i)/[a-z0-9._~/-]+", " <path> "),
        (r"(?i)\b[0-9a-f]{8,}\b", " <id> "),
        (r"\b\d+\b", " <n> "),
        (r"[^a-z0-9<> ]+", " "),
    ):
        out = F.regexp_replace(out, pattern, put)
    return F.nullif(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def objective_label(text: Column, most: int = 110) -> Column:
    return F.substring(squeeze(first_line(text)), 1, most)


def clip(text: Column, most: int) -> Column:
    """Squeezed text of at most `most` characters, the last an ellipsis where it is cut; null if empty."""
    flat = squeeze(text)
    return F.nullif(F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…"))), F.lit(""))


def clean_path(value: Column) -> Column:
    """A path word without quotes, trailing commas, file scheme and line numbers."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(value), r"^[\"']+|[\"']+$", ""), r"[,;]+$", ""), r"^file://", "")
    base = F.regexp_extract(bare, r"^(.*?):\d+(?::\d+)?$", 1)
    return F.when((base != "") & F.regexp_like(base, F.lit(r"[/\\.]")), base).otherwise(bare)


def looks_like_path(value: Column) -> Column:
    c = clean_path(value)
    leaf = F.regexp_extract(c, r"([^/]*)$", 1)
    refused = (c == "") | F.regexp_like(c, F.lit(r"[\n\r]|^[A-Za-z][A-Za-z0-9+.-]*://|^-")) | c.isin(".", "..")
    taken = F.regexp_like(c, F.lit(r"[/\\*?\[\]]|^~|^\..")) | F.lower(leaf).isin(*COMMON_FILES) | F.regexp_like(leaf, F.lit(r"\.[A-Za-z0-9]{1,10}$"))
    return ~refused & taken


def event_time(stamp: Column) -> Column:
    """ISO text as a timestamp, null if malformed."""
    return F.try_to_timestamp(stamp)


def event_day(stamp: Column) -> Column:
    """UTC day of an ISO time stamp; naive stamps are UTC; null if malformed."""
    return F.date_format(event_time(stamp), "yyyy-MM-dd")


def duration_seconds(first: Column, last: Column) -> Column:
    """Seconds between two stamps, at least 0; null unless both parse and both or neither have an offset."""
    zoned = lambda c: F.regexp_like(c, F.lit(r"(?:Z|[+-]\d{2}:?\d{2})$"))
    span = (F.unix_micros(event_time(last)) - F.unix_micros(event_time(first))) / F.lit(1e6)
    return F.when(zoned(first) == zoned(last), F.greatest(F.lit(0.0), span))


def share(part: Column, whole: Column) -> Column:
    """Percent with one decimal; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(0.0)
