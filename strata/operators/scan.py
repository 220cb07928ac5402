"""Publication scan: findings of credentials and personal data, masking, and what they recommend."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import filters

# Fixed values: (title, category, severity, pattern with a group `secret` where less than the match is
# the secret, check). Patterns are in the common syntax of Python and Java.
RULES = (
    ("Private key material", "secret", "high", r"(?P<secret>-----BEGIN (?P<pem>[A-Z0-9 ]{0,64}PRIVATE KEY)-----[\s\S]{0,65536}?-----END (?P=pem)-----)", None),
    ("Private key material", "secret", "high", r"-----BEGIN [A-Z0-9 ]{0,64}PRIVATE KEY-----", None),
    ("Token or credential", "secret", "high", r"(?<![A-Za-z0-9_])(?P<secret>gh[pousr]_[A-Za-z0-9_]{20,255}|sk-(?:proj-)?[A-Za-z0-9]{20,255}|sk-ant-[A-Za-z0-9_-]{20,255}|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16})(?![A-Za-z0-9_])", None),
    ("GitHub fine-grained token", "secret", "high", r"(?<![A-Za-z0-9_])(?P<secret>github_pat_[A-Za-z0-9_]{22,255})(?![A-Za-z0-9_])", None),
    ("Slack token", "secret", "high", r"(?i)(?<![A-Za-z0-9_-])(?P<secret>xox[a-z]-[A-Za-z0-9-]{10,255})(?![A-Za-z0-9-])", None),
    ("JSON Web Token", "secret", "high", r"(?<![A-Za-z0-9_-])(?P<secret>[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,2048}\.[A-Za-z0-9_-]{16,1024})(?![A-Za-z0-9_-])", "jwt"),
    ("Google API key", "secret", "high", r"(?<![A-Za-z0-9_-])(?P<secret>AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])", None),
    ("Stripe live key", "secret", "high", r"(?<![A-Za-z0-9_])(?P<secret>(?:sk|rk)_live_[0-9A-Za-z]{16,255})(?![0-9A-Za-z])", None),
    ("Credentialed connection URI", "secret", "high", r"\b[A-Za-z][A-Za-z0-9+.-]{1,31}://[^\s:/@]{1,128}:(?P<secret>[^\s/@]{1,256})@[^\s/?#]{1,255}", None),
    ("Secret-like assignment", "secret", "high", r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s{0,256}(?::|=|\bis\b)\s{0,256}[\"']?(?P<secret>[A-Za-z0-9._\-/+=]{12,512})", None),
    ("Bearer credential", "secret", "high", r"(?i)\bbearer\s{1,256}(?P<secret>[A-Za-z0-9._\-/+=]{20,1024})", None),
    ("Basic authorization credential", "secret", "high", r"(?i)\bauthorization\s{0,256}:\s{0,256}basic\s{1,256}(?P<secret>[A-Za-z0-9+/]{8,1020}={0,2})", "basic"),
    ("Package registry token", "secret", "high", r"(?<![A-Za-z0-9_])(?P<secret>npm_[A-Za-z0-9]{30,128})(?![A-Za-z0-9])", None),
    ("Package registry token", "secret", "high", r"(?<![A-Za-z0-9_-])(?P<secret>pypi-[A-Za-z0-9_-]{40,255})(?![A-Za-z0-9_-])", None),
    ("Package registry token", "secret", "high", r"(?i)\b(?:_authToken|npmAuthToken|registry[_-]?token|pypi[_-]?token|nuget[_-]?key)\b[\"']?\s{0,256}(?::|=)\s{0,256}[\"']?(?P<secret>[A-Za-z0-9._\-/+=]{12,512})", None),
    ("Email address", "pii", "medium", r"(?P<secret>[\w.+-]{1,64}@[\w.-]{1,253}\.[A-Za-z]{2,63})", None),
    ("US Social Security number", "pii", "medium", r"(?<!\d)(?P<secret>\d{3}-\d{2}-\d{4})(?!\d)", "ssn"),
    ("Payment card number", "pii", "medium", r"(?<!\d)(?P<secret>(?:\d[ -]?){12,18}\d)(?!\d)", "card"),
    ("Phone number", "pii", "medium", r"(?i)(?<!\d)(?:\b(?:phone|telephone|mobile|cell|tel)\b\s{0,256}[:=]?\s{0,256})?(?P<secret>(?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4})(?!\d)", "us_phone"),
    ("Phone number", "pii", "medium", r"(?<!\w)(?P<secret>\+[1-9]\d{0,2}[ .-](?:\(?\d{2,4}\)?[ .-]){1,4}\d{3,4})(?!\d)", "phone"),
    ("Phone number", "pii", "medium", r"(?i)\b(?:phone|telephone|mobile|cell|tel)\b\s{0,256}[:=]\s{0,256}(?P<secret>\+?[1-9][0-9() .-]{6,24}\d)", "phone"),
    ("Absolute home path", "pii", "medium", r"(?<!\w)(?P<secret>(?:/Users/[^/\s\"'`]{1,255}|/home/[^/\s\"'`]{1,255}|~/[^/\s\"'`]{1,255})(?:/[^\s\"'`]{1,255}){0,32})", None),
    ("Windows home path", "pii", "medium", r"(?i)(?<!\w)(?P<secret>[A-Z]:\\{1,2}Users\\{1,2}[^\\\s\"'`]{1,255}(?:\\{1,2}[^\\\s\"'`]{1,255}){0,32})", None),
    ("High-entropy token", "secret", "high", r"(?<![A-Za-z0-9_])(?P<secret>[A-Za-z0-9][A-Za-z0-9_+=-]{30,510}[A-Za-z0-9=])(?![A-Za-z0-9_])", "entropy"),
)
# Token prefixes that other rules name.
NAMED_PREFIXES = ("sk-", "sk_", "xox", "aiza", "npm_", "pypi-", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyj")
SEVERITY = ("medium", "high")
VISIBILITY = ("private", "unlisted", "public")
STATUSES = ("exploration", "success", "partial", "failed")


def _json_part(part: str):
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error):
        return None


def is_jwt(token: str) -> bool:
    head, body, sign = token.split(".")
    header = _json_part(head)
    return isinstance(header, dict) and bool(header.get("alg")) and isinstance(_json_part(body), dict) and len(sign) >= 16


def is_basic(token: str) -> bool:
    try:
        user, colon, word = base64.b64decode(token, validate=True).partition(b":")
    except (ValueError, binascii.Error):
        return False
    return bool(user and colon and word)


def is_ssn(number: str) -> bool:
    return not re.match(r"000|666|9|\d{3}-00|\d{3}-\d\d-0000", number)


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def is_card(number: str) -> bool:
    """13 to 19 digits, not all alike, whose Luhn sum ends in 0."""
    d = digits(number)
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def is_phone(number: str) -> bool:
    d = digits(number)
    return 8 <= len(d) <= 15 and len(set(d)) > 2


def is_us_phone(number: str) -> bool:
    """A number of the North American plan that is no service code and no counter."""
    d = digits(number)
    d = d[1:] if len(d) == 11 and d[0] == "1" else d
    if not re.fullmatch(r"(?!.11)[2-9]\d\d(?!.11)[2-9]\d\d(?!0000)\d{4}", d):
        return False
    steps = {(int(b) - int(a)) % 10 for a, b in zip(d, d[1:])}
    return len(set(d)) > 2 and steps not in ({1}, {9})


def is_entropic(token: str) -> bool:
    """10 or more symbols of 3 or more kinds with 4 bits each on average, and no named prefix."""
    if token.lower().startswith(NAMED_PREFIXES) or re.fullmatch(r"[0-9A-Fa-f]+", token):
        return False
    counts = Counter(token)
    kinds = sum(bool(re.search(p, token)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[_+/=-]"))
    bits = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    return len(counts) >= 10 and kinds >= 3 and bits >= 4.0


CHECKS = {"jwt": is_jwt, "basic": is_basic, "ssn": is_ssn, "card": is_card, "us_phone": is_us_phone, "phone": is_phone, "entropy": is_entropic}
_COMPILED = [(title, category, severity, re.compile(pattern), CHECKS.get(check)) for title, category, severity, pattern, check in RULES]


def spans(text: str, rules: Iterable[int] = range(len(RULES))) -> list[tuple[int, int, int]]:
    """(rule number, start, end) of every secret that its rule's check passes."""
    out = []
    for number in rules:
        _, _, _, pattern, check = _COMPILED[number]
        group = "secret" if "secret" in pattern.groupindex else 0
        out += [(number, *m.span(group)) for m in pattern.finditer(text) if check is None or check(m[group])]
    return out


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def masked(text: str, ranges: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in ranges:
        out += [text[at:start], "[MASKED]"]
        at = end
    return "".join([*out, text[at:]])


def excerpt(text: str, start: int, end: int, ranges: list[tuple[int, int]], around: int = 80, most: int = 180) -> str:
    """The finding's line, up to `around` characters on either side, everything found masked."""
    low = max(text.rfind("\n", 0, start) + 1, start - around)
    high = min(len(text) if text.find("\n", end) < 0 else text.find("\n", end), end + around)
    shown = masked(text[low:high], [(max(s, low) - low, min(e, high) - low) for s, e in ranges if s < high and e > low])
    shown = " ".join(shown.split())
    return shown if len(shown) <= most else shown[: most - 1] + "…"


FINDING = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("rule", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("line", T.IntegerType()), ("excerpt", T.StringType()))]))

# Whether a rule may have a finding is asked of whole columns, by patterns without looks aside and with counts at their least, so that one
# walk over a text answers. They meet every text that the rule meets: what Python may take for a letter, for white space or for another
# case of a letter is here any character past ASCII, and a digit is one of Python's.
_PAST = r"\x{80}-\x{10FFFF}"
_ZEROS = [n for n in range(0x110000) if chr(n).isdecimal() and unicodedata.decimal(chr(n)) == 0]
_PARTS = {"digit": "[" + "".join(rf"\x{{{n:x}}}-\x{{{n + 9:x}}}" for n in _ZEROS) + "]", "space": rf"[\x09-\x0d\x1c-\x20{_PAST}]", "value": rf"[A-Za-z0-9._\-/+={_PAST}]", "quote": "[\"']?", "past": _PAST}


def _gate(pattern: str) -> str:
    """<digit> and the like stand for their part, and <:word:> for a word in any case."""
    pattern = re.sub(r"<:(\w+):>", lambda m: "".join(rf"[{c.lower()}{c.upper()}{_PAST}]" if c.isalpha() else c for c in m[1]), pattern)
    return re.sub(r"<(\w+)>", lambda m: _PARTS[m[1]], pattern)


#: Of each rule.
GATES = tuple(map(_gate, (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    r"gh[pousr]_[A-Za-z0-9_]{20}|sk-(?:proj-)?[A-Za-z0-9]{20}|sk-ant-[A-Za-z0-9_-]{20}|A[KS]IA[0-9A-Z]{16}", r"github_pat_[A-Za-z0-9_]{22}", r"<:xox:>[A-Za-z<past>]-[A-Za-z0-9<past>-]{10}",
    r"[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16}", r"AIza[0-9A-Za-z_-]{35}", r"[sr]k_live_[0-9A-Za-z]{16}", r"[A-Za-z0-9+.-]://[^ :/@]+:[^ /@]+@",
    r"(?:<:token:>|<:secret:>|<:passw:>(?:<:or:>)?<:d:>|<:api:>[_-]?<:key:>|<:access:>[_-]?<:key:>)<quote><space>*(?::|=|<:is:>)<space>*<quote><value>{12}", r"<:bearer:><space>+<value>{20}", r"<:authorization:><space>*:<space>*<:basic:><space>+[A-Za-z0-9+/<past>]{8}",
    r"npm_[A-Za-z0-9]{30}", r"pypi-[A-Za-z0-9_-]{40}", r"(?:_<:authToken:>|<:npmAuthToken:>|<:registry:>[_-]?<:token:>|<:pypi:>[_-]?<:token:>|<:nuget:>[_-]?<:key:>)<quote><space>*[:=]<space>*<quote><value>{12}",
    r"[A-Za-z0-9_.+<past>-]@[A-Za-z0-9_.<past>-]+\.[A-Za-z]{2}", r"<digit>{3}-<digit>{2}-<digit>{4}", r"(?:<digit>[ -]?){12}<digit>", r"(?:\(<digit>{3}\)|<digit>{3})[ .-]?<digit>{3}[ .-]?<digit>{4}",
    r"\+[1-9]<digit>{0,2}[ .-]\(?<digit>{2}", r"(?:<:phone:>|<:mobile:>|<:cell:>|<:tel:>)<space>*[:=]<space>*\+?[1-9]", r"/Users/[^/]|/home/[^/]|~/[^/]", r":\\{1,2}<:users:>\\", r"[A-Za-z0-9][A-Za-z0-9_+=-]{30}[A-Za-z0-9=]",
)))
_ANY = "|".join(dict.fromkeys(GATES))


def spotted(texts: pa.Array) -> tuple[list[int], list[list[int]]]:
    """Places of the texts that may have a finding, and the rules that may have one in each."""
    at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False))
    some = texts.take(at)
    hits = np.stack([pc.match_substring_regex(some, g).to_numpy(zero_copy_only=False) for g in GATES], axis=1).astype(bool)
    return at.to_pylist(), [np.flatnonzero(h).tolist() for h in hits]


def _each(texts: pa.Array, of, none) -> list:
    """`of` (text, its spans) of every text that has some, else `none`."""
    out = [none] * len(texts)
    for k, rules in zip(*spotted(texts)):
        text = texts[k].as_py()
        if found := spans(text, rules):
            out[k] = of(text, found)
    return out


@F.arrow_udf(FINDING)
def _find(texts: pa.Array) -> pa.Array:
    def told(text: str, found: list[tuple[int, int, int]]) -> list[dict]:
        ranges = merged([(s, e) for _, s, e in found])
        return [{"rule": r, "start": s, "end": e, "line": text.count("\n", 0, s) + 1, "excerpt": excerpt(text, s, e, ranges)} for r, s, e in found]
    return pa.array(_each(texts, told, []), pa.list_(pa.struct([("rule", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("excerpt", pa.string())])))


@F.arrow_udf(T.StringType())
def _mask(texts: pa.Array) -> pa.Array:
    """What is masked of the texts that have findings, null of others."""
    return pa.array(_each(texts, lambda text, found: masked(text, merged([(s, e) for _, s, e in found])), None), pa.string())


def mask(text: Column) -> Column:
    """Text with everything found masked."""
    return F.coalesce(_mask(text), text)


def findings(rows: DataFrame, key: str = "session_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per finding, each title and place once."""
    names = lambda i: F.get(F.array(*[F.lit(r[i]) for r in RULES]), F.col("f.rule"))
    one = rows.select(key, F.col(source).alias("source"), F.explode(_find(text)).alias("f"))
    return one.select(key, "source", names(1).alias("category"), names(2).alias("severity"), names(0).alias("title"), "f.line", "f.start", "f.end", "f.excerpt").dropDuplicates([key, "source", "category", "severity", "title", "line", "start"])


def shown_findings(found: DataFrame, key: str = "session_id", most: int = 5) -> DataFrame:
    """At most `most` findings of each kind, with how many there are; severe ones first."""
    kind = Window.partitionBy(key, "source", "category", "severity", "title")
    rows = found.withColumn("total", F.count(F.lit(1)).over(kind)).withColumn("_n", F.row_number().over(kind.orderBy("line", "start"))).filter(F.col("_n") <= most).drop("_n")
    return rows.orderBy(key, F.when(F.col("severity") == "high", 0).otherwise(1), "source", "line", "start", "title")


# Metadata that a publication shows, in the order of the review.
METADATA = (
    "display_name", "bio", "avatar_url", "username", "repo_name", "project", "first_user_message", "machine", "model", "git_branch", "git_commit", "session_goal",
    "session_summary", "session_outcome", "session_status", "session_origin", "objective_family", "objective_label", "source_path", "shared_path",
    "workspace_root", "worktree_root", "repo_root",
)


def metadata_rows(sessions: DataFrame, fields: list[str], key: str = "session_id") -> DataFrame:
    """Metadata fields as texts `field: value` to scan."""
    values = F.array(*[F.struct(F.lit(f).alias("source"), F.concat(F.lit(f"{f}: "), F.col(f).cast("string")).alias("text")) for f in fields])
    return sessions.select(key, F.explode(values).alias("m")).select(key, "m.*").filter("text is not null")


def recommendation(sessions: DataFrame, found: DataFrame, key: str = "session_id", readable: Column | None = None) -> DataFrame:
    """private with a severe finding or an unreadable file, unlisted with any, else public."""
    worst = found.groupBy(key).agg(F.max(F.when(F.col("severity") == "high", 2).otherwise(1)).alias("worst"))
    lost = F.lit(False) if readable is None else ~F.coalesce(readable, F.lit(False))
    level = F.when(lost | (F.col("worst") == 2), "private").when(F.col("worst") == 1, "unlisted").otherwise("public")
    return sessions.join(worst, key, "left").select(key, level.alias("recommendation"))


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VISIBILITY]), level)


def may_apply(target: Column, recommended: Column, force: bool = False) -> Column:
    return F.lit(True) if force else rank(target) <= rank(recommended)


def metadata_sha(fields: list[str]) -> Column:
    """SHA-256 of the fields and values as a compact JSON array of pairs."""
    pairs = F.array(*[F.array(F.lit(f), F.col(f).cast("string")) for f in fields])
    return F.sha2(F.to_json(pairs), 256)


def queue(sessions: DataFrame, reviews: DataFrame, level: str = "pending", status: str | None = None, origin: str | None = None, username: str | None = None) -> DataFrame:
    """Sessions to publish: unlisted, then private, then others, newest first.

    `level` is one of the levels, `pending` (not public), `needs_changes` (the recommendation is stricter than what
    they are now) or `all`; a session without status counts as exploration, without origin as a person's own.
    """
    rows = sessions.join(reviews.select("session_id", "recommendation"), "session_id", "left")
    stricter = F.coalesce(rank(F.col("recommendation")) < rank(F.col("visibility")), F.lit(False))
    picked = {"pending": F.col("visibility") != "public", "needs_changes": stricter, "all": F.lit(True)} | {v: F.col("visibility") == v for v in VISIBILITY}
    if level not in picked:
        raise ValueError(f"unknown level: {level}")
    if status and status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    hit = picked[level]
    if status:
        hit = hit & (F.coalesce("session_status", F.lit("exploration")) == status)
    if origin:
        hit = hit & filters.origin(origin)
    if username:
        hit = hit & (F.col("username") == username)
    place = F.when(F.col("visibility") == "unlisted", 0).when(F.col("visibility") == "private", 1).otherwise(2)
    return rows.filter(hit).withColumn("needs_changes", stricter).orderBy(place, F.desc_nulls_last("first_timestamp"), F.desc("session_id"))
