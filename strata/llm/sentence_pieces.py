"""SentencePiece encoding and decoding of byte-pair models by a shared-prefix forward pass.

A text is cut in marked words (a run of spaces and what follows up to the next). The distinct words of a
stretch of texts are sorted, which lays them out as a trie in depth-first order, and one forward table runs
along: entry i holds the piece that ends the encoding of the word's first i + 1 characters, and a word keeps
the entries of the prefix that it shares with the word before it.

The public models are byte-pair models, whose best encoding is not the one of greatest score sum, so a
Viterbi maximum would give other pieces than the model's. What decides here is the model's own rule:
of the pieces that end at a place exactly one fits the piece before it, namely where applying the merges
in order to both together leaves them apart. That gives the model's ids and keeps the method's traversal.

Cases: null and empty texts have no pieces; characters outside the vocabulary become byte pieces; a
literal U+2581 becomes byte pieces too, so that decoding gives every text back; repeated rows are encoded
as rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.shared import parts, trimmed, utf8

MARKED = re.compile(r" +[^ ]*")


@dataclass
class Vocabulary:
    """Pieces of a byte-pair model with the mark written as a space. `rank` orders merges, -1 for none."""

    pieces: list[str]
    rank: list[int]
    byte_ids: list[int]
    parts: dict[int, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.rank[i] >= 0}
        self.apart: dict[int, bool] = {}
        # Some models rank all runs of spaces alike and last; these merge from the left (space_run).
        runs = [i for p, i in self.ids.items() if len(p) > 1 and not p.strip(" ")]
        ranks = [self.rank[i] for p, i in self.ids.items() if len(p) > 1 and p.strip(" ")]
        if len(set(ranks)) < len(ranks) or any(p.startswith("  ") and p.strip(" ") for p in self.ids):
            raise ValueError("pieces that tie in rank, or runs of spaces inside pieces, are not supported")
        self.runs = {len(self.pieces[i]): i for i in runs} if len({self.rank[i] for i in runs}) < len(runs) else {}
        if self.runs and min(self.rank[i] for i in runs) < max(ranks, default=0):
            raise ValueError("runs of spaces must merge last")
        for i in self.runs.values():
            del self.ids[self.pieces[i]]
        if not self.parts:
            self._find_parts()
        self.trie: dict = {}
        for piece, i in self.ids.items():
            if len(piece) > 1 and i not in self.parts:
                continue  # no merge makes it
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i

    def _find_parts(self) -> None:
        """The last merge of each piece: the one cut of it that earlier merges leave standing."""
        for piece, i in sorted(self.ids.items(), key=lambda x: self.rank[x[1]]):
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is None or b is None or any(len(self.pieces[x]) > 1 and x not in self.parts for x in (a, b)):
                    continue
                if max(self._made(a), self._made(b)) < self.rank[i] and self.stand_apart(a, b, self.rank[i]):
                    self.parts[i] = (a, b)
                    break

    def _made(self, i: int) -> int:
        return self.rank[i] if i in self.parts else -1

    def stand_apart(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether merges (those ranked under `below`) leave two neighbouring pieces as they are.

        The younger of the pieces is taken back to its parts, again and again; at each step the parts
        that face each other must not merge before the taken-back merge happens.
        """
        limit = below if below is not None else 1 << 60
        while True:
            joined = self.ids.get(self.pieces[a] + self.pieces[b])
            if joined is not None and self.rank[joined] < limit and joined in self.parts:
                return False
            ra, rb = self._made(a), self._made(b)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # The left piece is made only if nothing takes its right part away before.
                limit, a = min(limit, ra), self.parts[a][1]
            else:
                # On a tie of ranks the left pair merges first, so an equal rank disturbs the right piece.
                limit, b = min(limit, rb + 1), self.parts[b][0]

    def space_run(self, n: int) -> list[int]:
        """Ids of n spaces: the leftmost pair that makes a piece merges, which a stack follows."""
        held: list[int] = []
        for _ in range(n):
            held.append(1)
            while len(held) > 1 and held[-2] + held[-1] in self.runs:
                last = held.pop()
                held[-1] += last
        return [self.runs[k] if k > 1 else self.ids[" "] for k in held]

    def fits(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        held = self.apart.get(key)
        if held is None:
            if len(self.apart) > 400_000:
                self.apart.clear()
            held = self.apart[key] = self.stand_apart(a, b)
        return held


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece byte-pair model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    byte_ids = [i for i in range(n) if model.is_byte(i)]
    rank = [-1 if kinds[i] else int(-model.get_score(i)) for i in range(n)]
    names = [model.id_to_piece(i) for i in range(n)]
    return Vocabulary([x if k else x.replace("▁", " ") for x, k in zip(names, kinds)], rank, byte_ids)


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another in the order given, and the n + 1 offsets."""
    if v.runs:
        spaces = [len(w) - len(w.lstrip(" ")) for w in words]
        cores = dict.fromkeys(" " * min(k, 1) + w[k:] for w, k in zip(words, spaces))
        held = dict(zip(cores, _encode_cores(list(cores), v)))
        out = []
        for w, k in zip(words, spaces):
            ids = held[" " * min(k, 1) + w[k:]]
            if k > 1:
                alone = ids[0] == v.ids[" "]
                ids = v.space_run(k if alone else k - 1) + ids[alone:]
            out.append(ids)
    else:
        out = _encode_cores(words, v)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
    return np.fromiter((i for x in out for i in x), np.int32, int(offsets[-1])), offsets


def _encode_cores(words: list[str], v: Vocabulary) -> list[list[int]]:
    order = sorted(range(len(words)), key=words.__getitem__)
    out: list[list[int]] = [[]] * len(words)
    ends: list[int] = []  # the piece that ends at each place; -1 for a character outside the vocabulary
    lengths: list[int] = []
    walks: list[list[tuple[int, dict]]] = []  # of each place, vocabulary nodes of the pieces still running
    before = ""
    root, fits = v.trie, v.fits
    for number in order:
        word = words[number]
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del ends[shared:], lengths[shared:], walks[shared:]
        for i in range(shared, len(word)):
            c = word[i]
            running = [(j, node[c]) for j, node in (walks[i - 1] if i else ()) if c in node]
            if c in root:
                running.append((i, root[c]))
            walks.append(running)
            piece, size = -1, 1
            for j, node in running:
                t = node.get("")
                if t is not None and (j == 0 or ends[j - 1] < 0 or fits(ends[j - 1], t)):
                    piece, size = t, i - j + 1
                    break
            ends.append(piece)
            lengths.append(size)
        ids, i = [], len(word) - 1
        while i >= 0:
            if ends[i] < 0:
                ids += [v.byte_ids[b] for b in reversed(word[i].encode())]
            else:
                ids.append(ends[i])
            i -= lengths[i]
        out[number] = ids[::-1]
        before = word
    return out


def gather(values: np.ndarray, offsets: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """values[offsets[p] : offsets[p + 1]] of every p in `picked`, one after another."""
    sizes = (offsets[1:] - offsets[:-1])[picked]
    total = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(total[-1]) + np.repeat(offsets[:-1][picked] - total[:-1], sizes)]


def _encode(vocabulary, stretch: int = 3 << 20):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column("text"))
            for i, j in parts(offsets, stretch):
                numbers: dict[str, int] = {}
                codes, counts = [], []
                for k in range(i, j):
                    text = bytes(data[offsets[k] : offsets[k + 1]]).decode()
                    found = MARKED.findall(" " + text) if text else []
                    codes += [numbers.setdefault(w, len(numbers)) for w in found]
                    counts.append(len(found))
                ids, at = encode_words(list(numbers), v)
                picked = np.array(codes, np.int64)
                flat = gather(ids, at, picked)
                ends = np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[picked])])[np.concatenate([[0], np.cumsum(counts)])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], ["doc_id", "ids"])
    return rows


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, ids. The vocabulary is read on the driver and broadcast; its
    size is the model's."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_encode(vocabulary), T.StructType([base.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _decode(vocabulary):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        single = {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        pieces = [single.get(i, p.encode() if v.rank[i] >= 0 else b"") for i, p in enumerate(v.pieces)]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        for batch in trimmed(batches):
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            texts = []
            for k in range(len(lists)):
                text = gather(data, at, flat[ends[k] : ends[k + 1]]).tobytes()
                texts.append(text[1:].decode(errors="replace") if text else "")  # without the leading mark
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])
    return rows


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds `decoded` to rows with `ids`."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    return encoded.mapInArrow(_decode(vocabulary), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def encode_and_check(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every row. A task's one worker encodes and decodes, so the vocabulary's tables stand
    once in it, and ids are not sent to another."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [base.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    there, back = _encode(vocabulary), _decode(vocabulary)
    found = base.mapInArrow(lambda batches: back(there(batches)), T.StructType(fields))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
