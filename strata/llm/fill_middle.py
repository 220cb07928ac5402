"""Fill-in-the-middle rearrangement over ropes.

A text is a rope: a balanced tree over leaves of about `leaf` bytes that are cut between units, where a unit is a word
with the white space before it, or white space at the end. Every node caches its units and code points. A cut goes down one path by
unit rank and reads one leaf; prefix, middle and suffix are subtrees, and their code points are at hand. The
rearranged text is the same subtrees joined with sentinels. `restore` inverts it: it makes a rope of the
output, splits it at the code-point ranks of its sentinels, and joins the parts in the order of the text. A text
that holds a sentinel is left as it is, so the sentinels of an output are unambiguous.

Forms and cuts are drawn from a SHA-256 of seed and id, so reruns agree. The work is one pass over Arrow batches without a
shuffle; a task holds one batch and the text that it works on.

Cases: null text is empty; a null id is hashed as an empty string; rows of one id are cut alike where their texts are;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.shared import parts, trimmed, utf8

#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass(slots=True, frozen=True)
class Rope:
    """A leaf with bytes, or the join of two ropes."""

    units: int
    chars: int
    data: bytes = b""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[bytes]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.data
            else:
                todo += [node.right, node.left]


EMPTY = Rope(0, 0)


def code_points(data: bytes) -> int:
    return len(data.decode())


def joined(*ropes: Rope) -> Rope:
    """A balanced tree over ropes in order; empty ones are left out."""
    level = [r for r in ropes if r.chars]
    while len(level) > 1:
        pairs = [Rope(a.units + b.units, a.chars + b.chars, b"", a, b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0] if level else EMPTY


def mark(sentinel: str) -> Rope:
    return Rope(1, len(sentinel), sentinel.encode())


def rope_of(data: bytes, ends: np.ndarray, leaf: int = 4096) -> Rope:
    """A rope of UTF-8 bytes whose units end at `ends`."""
    if len(data) <= leaf:
        return Rope(len(ends), code_points(data), data) if data else EMPTY
    cuts = np.unique(np.searchsorted(ends, np.arange(leaf, len(data) + leaf, leaf)).clip(max=len(ends) - 1))
    leaves, begin, seen = [], 0, 0
    for k in cuts.tolist():
        end = int(ends[k])
        leaves.append(Rope(k + 1 - seen, code_points(data[begin:end]), data[begin:end]))
        begin, seen = end, k + 1
    return joined(*leaves)


def _cut_leaf(data: bytes, rank: int, by: str) -> int:
    """The byte at which `rank` units or code points of a leaf end."""
    if by == "chars":
        return len(data.decode()[:rank].encode())
    units = UNIT.finditer(data)
    return next(m.end() for k, m in enumerate(units, 1) if k == rank)


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units (or chars) of a rope, and the rest: one path of the tree is walked, one leaf cut."""
    lefts, rights = [], []
    while True:
        if rank <= 0:
            rights.append(rope)
            break
        if rank >= getattr(rope, by):
            lefts.append(rope)
            break
        if rope.left is None:
            at = _cut_leaf(rope.data, rank, by)
            first, rest = rope.data[:at], rope.data[at:]
            units = rank if by == "units" else len(UNIT.findall(first))
            chars = rank if by == "chars" else code_points(first)
            lefts.append(Rope(units, chars, first))
            rights.append(Rope(rope.units - units if by == "units" else len(UNIT.findall(rest)), rope.chars - chars, rest))
            break
        if rank < getattr(rope.left, by):
            rights.append(rope.right)
            rope = rope.left
        else:
            lefts.append(rope.left)
            rank -= getattr(rope.left, by)
            rope = rope.right
    return joined(*lefts), joined(*reversed(rights))


def flat(rope: Rope) -> bytes:
    return b"".join(rope.leaves())


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the units of all texts, and each text's place in them (n + 1)."""
    space = _SPACE[data]
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    last &= ~space
    edges = offsets[1:][np.diff(offsets) > 0]
    last[edges - 1] = True  # a text's end also ends its last word, or its trailing white space
    ends = np.flatnonzero(last) + 1
    return ends, np.searchsorted(ends, offsets, side="right")


def rearranged(text: Rope, low: int, high: int, form: str) -> tuple[Rope, int, int]:
    """The rope of a form, with the code points of prefix and middle."""
    front, suffix = split(text, high)
    prefix, middle = split(front, low)
    if form == "psm":
        out = joined(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    else:
        out = joined(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    return out, prefix.chars, middle.chars


def restored(output: str, form: str) -> str:
    """The text of an output of `form`."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    then = output.index(MIDDLE, at + len(second))
    data = output.encode()
    ends, _ = unit_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    rope = rope_of(data, ends)
    front, rest = split(rope, then, "chars")
    middle = split(rest, len(MIDDLE), "chars")[1]
    one, two = split(front, at, "chars")
    one, two = split(one, len(first), "chars")[1], split(two, len(second), "chars")[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return flat(joined(prefix, middle, suffix)).decode()


FIELDS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]


def _transform(rate: int, spm_rate: int):
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column("text"))
            draws = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
            for i, j in parts(offsets):
                own = offsets[i : j + 1] - offsets[i]
                held = data[offsets[i] : offsets[j]]
                ends, place = unit_ends(held, own)
                out: list[tuple] = []
                for k in range(j - i):
                    text, units = held[own[k] : own[k + 1]].tobytes(), int(place[k + 1] - place[k])
                    h1, h2, h3, h4 = (int(h[i + k]) for h in draws)
                    if not text or h3 % 100 >= rate or any(m in text for m in marks):
                        out.append((units, "plain", None, None, text))
                        continue
                    form = "spm" if h4 % 100 < spm_rate else "psm"
                    low, high = sorted((h1 % (units + 1), h2 % (units + 1)))
                    rope, prefix, middle = rearranged(rope_of(text, ends[place[k] : place[k + 1]] - own[k]), low, high, form)
                    out.append((units, form, prefix, middle, flat(rope)))
                n, form, prefix, middle, texts = zip(*out)
                arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *arrays], ["doc_id", *[f[0] for f in FIELDS]])
    return rows


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    `rate` percent of the texts are rearranged, `spm_rate` percent of those with the suffix first.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number: list[Column] = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), drawn.alias("h")).select("doc_id", "text", *number)
    return base.mapInArrow(_transform(rate, spm_rate), T.StructType([base.schema["doc_id"], *[T.StructField(*f) for f in FIELDS]]))


@F.arrow_udf(T.StringType())
def _restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    return pa.array([None if o is None else restored(o, f) for o, f in zip(outputs.to_pylist(), forms.to_pylist())], pa.string())


def restore(rows: DataFrame) -> DataFrame:
    """Adds `restored`, the text read back from `output` and `form`."""
    return rows.withColumn("restored", _restored("output", "form"))


def digest(rows: DataFrame) -> DataFrame:
    """Hashes in place of the texts."""
    told = restore(rows)
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
