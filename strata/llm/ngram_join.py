"""Jaccard self-join of word-shingle sets and its connected components.

Equal sets are one class with one representative. A class meets others through the rarest fifth of its
shingles (two sets of similarity t share one of the n - ceil(t n) + 1 first of any common order), where
shingles that batches of the corpus often repeat come last. Inside each such bucket the method works on
count vectors: shingles are hashed to GROUPS groups, a set is the point of its group counts, points are
bulk-loaded in an R-tree of leaves and nodes, and a branch is cut where the sum of coordinate minima
(the most two sets can share) is below what the threshold asks for. Only pairs that survive are verified
on their whole sets.

The tree alone cannot deal rows to tasks: same-sized sets of unrelated texts lie close in count space, so
its upper levels prune little. Hence the buckets, which lose no pair. Copies are not expanded in pairs:
each bucket first links its members to a few leaders; what is verified is contracted, and only pairs
between different components are asked for after that.

No bucket is gathered whole. One of more than `block` rows is hot: the first pass deals its members by a hash
to parts of about `block` and chooses leaders in each; parts differ between tokens of different orders, so that
links of several buckets bring parts together. All members of a hot bucket go to the second pass, where
buckets of one component end. The others are cut by size class (linked sets are in one or in neighbouring
classes) and dealt in blocks; each two blocks that hold pairs to ask for are a cell of their own.

Cases: a text without words, or null, has an empty set and links with nothing; a null id takes part in
no link and its component is null; rows repeated with id and text count once; of several texts under one id
the links of any may count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.graph import components
from strata.llm.shared import as_rows, few, mix, parts, ranked, staged, text_or_empty, trimmed, utf8, windows, word_hashes

GROUPS = 64
#: Orders in which large buckets choose leaders; a member meets at most so many leaders of its kind.
ORDERS = 16
#: Groups of the finer vectors that whole sets carry.
FINE = 1024
LEAF = 32
CLASS = ["n", "c1", "c2"]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words, at = word_hashes(data, offsets, lower=True)
    hashes = windows(words, size)
    for i in range(len(offsets) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= size:
            yield np.unique(hashes[a : b - size + 1])
        elif b > a:
            yield mix(windows(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield hashes[:0]


def least_overlap(a, b, percent: int):
    """Fewest shared shingles of linked sets of a and b shingles: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """R-tree over count vectors, bulk-loaded in order of size; nodes hold LEAF leaves."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((vectors.argmax(axis=1), sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.leaves = self._level(self.vectors, self.sizes, self.sizes)
        self.nodes = self._level(*self.leaves)

    @staticmethod
    def _level(upper: np.ndarray, low: np.ndarray, high: np.ndarray):
        at = np.arange(0, len(low), LEAF)
        return np.maximum.reduceat(upper, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)

    @staticmethod
    def _open(vector: np.ndarray, size: int, upper: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
        fits = (100 * low <= 100 * 100 * size // percent) & (100 * high >= percent * size)
        need = least_overlap(size, np.maximum(low, -(-percent * size // 100)), percent)
        fits[fits] = np.minimum(upper[fits], vector).sum(axis=1, dtype=np.int64) >= need[fits]
        return fits

    def near(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points (numbers as given to the tree) that a set with this vector may be linked to."""
        found = np.arange(len(self.nodes[1]))
        for below in (self.nodes, self.leaves, (self.vectors, self.sizes, self.sizes)):
            upper, low, high = (x[found] for x in below)
            found = found[self._open(vector, size, upper, low, high, percent)]
            if below[1] is not self.sizes:
                n = len(self.sizes) if below is self.leaves else len(self.leaves[1])
                found = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
                found = found[found < n]
        return self.order[found]


def scaled(counts: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """Counts divided by a power of two so that none exceeds `most`, rounded up: bounds stay bounds."""
    scale = 0
    while -(-int(counts.max()) >> scale) > most:
        scale += 1
    return scale, (-(-counts >> scale)).astype(np.uint8)


def packed(counts: np.ndarray) -> bytes:
    """A count vector with half a byte a group, after the exponent of its scale."""
    scale, small = scaled(counts, 15)
    return bytes([scale]) + (small[::2] | small[1::2] << 4).tobytes()


def packed_fine(counts: np.ndarray) -> bytes:
    """A count vector with a byte a group, after the exponent of its scale."""
    scale, small = scaled(counts, 255)
    return bytes([scale]) + small.tobytes()


def _raw(vectors: pa.Array, width: int) -> np.ndarray:
    at = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset]
    return np.frombuffer(vectors.buffers()[2], np.uint8)[at : at + len(vectors) * (width + 1)].reshape(-1, width + 1)


def unpacked(vectors: pa.Array) -> np.ndarray:
    """Count vectors (uint32) of packed ones."""
    raw = _raw(vectors, GROUPS // 2)
    out = np.empty((len(raw), GROUPS), np.uint32)
    out[:, ::2], out[:, 1::2] = raw[:, 1:] & 15, raw[:, 1:] >> 4
    return out << raw[:, :1].astype(np.uint32)


def set_class(s: np.ndarray) -> tuple[int, int, int]:
    """Size and two 64-bit hashes of a set."""
    if not len(s):
        return 0, 0, 0
    return len(s), int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def _survey(size: int, least: int, stretch: int = 8 << 20):
    """Rows of two kinds: each document's set class and count vector; and shingles (token, count) that at
    least `least` texts of a stretch of the input share."""
    schema = pa.schema([("doc_id", pa.int64()), ("xx", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("vector", pa.binary()), ("token", pa.int64()), ("count", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column("text"))
            for i, j in parts(offsets, stretch):
                sets = []
                for p, q in parts(offsets[i : j + 1] - offsets[i]):
                    sets += shingle_sets(data[offsets[i + p] : offsets[i + q]], offsets[i + p : i + q + 1] - offsets[i + p], size)
                n, c1, c2 = (pa.array(x, pa.int64()) for x in zip(*map(set_class, sets)))
                vectors = pa.array([packed(np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)) for s in sets], pa.binary())
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("xx").slice(i, j - i), n, c1, c2, vectors, none, none], schema=schema)
                every = np.sort(np.concatenate(sets))
                new = np.flatnonzero(np.r_[len(every) > 0, every[1:] != every[:-1]])
                count = np.diff(np.r_[new, len(every)])
                often = new[count >= least]
                none = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(often), pa.binary()), pa.array(every[often].view(np.int64)), pa.array(count[count >= least])], schema=schema)
    return rows


def frequent_shingles(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` shingles (16 bytes each) that the corpus repeats most, sorted, and their ranks.

    Every text is read. The list only orders shingles; no pair depends on what it holds.
    """
    counts = found.groupBy("token").agg(F.sum("count").alias("count"))
    held = staged(counts.withColumn("level", F.floor(F.log2("count")).cast("int")), "frequent")
    level, total = 63, 0
    for row in sorted(held.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        if total + row["n"] > most:
            break
        level, total = row["level"], total + row["n"]
    rows = held.filter(F.col("level") >= level).select("token", "count").toArrow()
    tokens, counts = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    ranks = np.empty(len(tokens), np.uint64)
    ranks[np.lexsort((tokens, counts))] = np.arange(len(tokens), dtype=np.uint64)
    order = np.argsort(tokens)
    return tokens[order], ranks[order]


def _prefixes(size: int, percent: int, frequent):
    """(token, rep): the first shingles of each set in the common order. A stretch names equal sets once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, ranks = frequent.value
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            seen: set[tuple[int, int, int]] = set()
            for i, j in parts(offsets):
                tokens, owners = [], []
                for k, s in zip(range(i, j), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)):
                    kind = set_class(s)
                    if not len(s) or kind in seen:
                        continue
                    seen.add(kind)
                    key = s >> np.uint64(1)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        key = np.where(often[at] == s, (np.uint64(1) << np.uint64(63)) | ranks[at], key)
                    take = len(s) - -(-percent * len(s) // 100) + 1
                    tokens.append(s[np.argsort(key, kind="stable")[:take]].view(np.int64))
                    owners.append(np.full(take, ids[k], np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], ["token", "rep"])
    return rows


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row but the first differs from the row before."""
    return np.any([c[1:] != c[:-1] for c in columns], axis=0)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of batches sorted by `keys` and rep, several at a time; a member's copies are dropped as they come."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in trimmed(batches):
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in [*keys, "rep"]]
        once = np.r_[last != [c[0] for c in columns], _changes(columns)]
        last = [c[-1] for c in columns]
        if not once.any():
            continue
        batch = batch if once.all() else batch.filter(pa.array(once))
        columns = [c[once] for c in columns[:-1]]
        new = np.flatnonzero(_changes(columns))
        if len(new):
            cut = int(new[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and [held[-1].column(k)[0].as_py() for k in keys] != [c[0] for c in columns]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


#: Columns that tell the groups of the two passes apart.
PART, CELL = ["token", "part"], ["token", "ca", "cb"]


def _columns(table: pa.Table):
    """token, part, rep, n, vectors of whole groups, and the offsets of the groups."""
    table = table.combine_chunks()
    token, part, rep, n = (table.column(c).to_numpy() for c in (*PART, "rep", "n"))
    new = np.flatnonzero(np.r_[True, _changes([token, part])])
    return token, part, rep, n, unpacked(table.column("vector").chunk(0)), np.r_[new, len(token)]


#: Kinds of rows that buckets give: a pair, a pair to verify first, and (token, member) of a large or a hot bucket.
PAIR, FIRST, MEMBER, HOT = 0, 1, 2, 3


def _rows_of(a, b, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.broadcast_to(kind, len(a)), pa.int32())], ["a", "b", "kind"])


def _pair_batch(a, b, kind) -> pa.RecordBatch:
    return _rows_of(np.minimum(a, b), np.maximum(a, b), kind)


def _small_pairs(rep: np.ndarray, n: np.ndarray, vectors: np.ndarray, at: np.ndarray, small: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of buckets of at most `small` members that the bound leaves, one distance in the bucket at a time."""
    sizes = np.diff(at)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(rep)) - at[:-1][bucket]
    room = np.where(sizes <= small, sizes, 0)[bucket]
    for d in range(1, small):
        i = np.flatnonzero(place + d < room)
        if not len(i):
            return
        fits = (100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])) & (rep[i] != rep[i + d])
        i = i[fits]
        shared = np.minimum(vectors[i], vectors[i + d]).sum(axis=1, dtype=np.int64)
        i = i[shared >= least_overlap(n[i], n[i + d], percent)]
        yield _pair_batch(rep[i], rep[i + d], np.where(place[i] == 0, FIRST, PAIR).astype(np.int32))


def _leaders(percent: int, small: int):
    """Rows (a, b, kind). Of small buckets every pair that the bound leaves, FIRST where one is the bucket's
    first; of large ones each member with its leader, and the members that the bound leaves with anyone. A part
    of a hot bucket cannot tell who is alone, and gives all its members."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, PART):
            token, part, rep, n, vectors, at = _columns(table)
            hot = part >= 0
            if hot.any():
                yield _rows_of(token[hot], rep[hot], HOT)
            yield from _small_pairs(rep, n, vectors, at, small, percent)
            for k in np.flatnonzero(np.diff(at) > small):
                held = np.arange(at[k], at[k + 1])
                tree = CountTree(vectors[held], n[held])
                taken, active = np.zeros(len(held), bool), np.zeros(len(held), bool)
                for lead in np.argsort(mix(rep[held].view(np.uint64) ^ np.uint64(int(token[at[k]]) % ORDERS))):
                    if taken[lead]:
                        continue
                    near = tree.near(vectors[held[lead]], int(n[held[lead]]), percent)
                    near = near[near != lead]
                    active[lead] = len(near) > 0
                    led = near[~taken[near]]
                    taken[lead] = taken[led] = active[led] = True
                    if len(led):
                        yield _pair_batch(np.full(len(led), rep[held[lead]]), rep[held[led]], FIRST)
                if active.any() and not hot[at[k]]:
                    yield _rows_of(np.full(active.sum(), token[at[k]]), rep[held[active]], MEMBER)
    return rows


def _finer(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Finer vectors as they are packed: bytes, and the scales' exponents."""
    raw = _raw(vectors, FINE)
    return raw[:, 1:], raw[:, :1]


def _fine_overlap(small: np.ndarray, scale: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Most that set i can share with the others by their finer vectors."""
    if not scale[i] and not scale[others].any():
        return np.minimum(small[others], small[i]).sum(axis=1, dtype=np.int64)
    fine = small[others].astype(np.uint32) << scale[others].astype(np.uint32)
    return np.minimum(fine, small[i].astype(np.uint32) << np.uint32(scale[i, 0])).sum(axis=1, dtype=np.int64)


def _across(percent: int):
    """Pairs of different components that the bounds leave: each bucket's or cell's tree over GROUPS groups, then
    the finer vectors of what it finds. A cell of two blocks gives pairs of one with the other."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, CELL):
            table = table.combine_chunks()
            token, ca, cb, block, rep, n, component = (table.column(c).to_numpy() for c in (*CELL, "block", "rep", "n", "component"))
            small, scale = _finer(table.column("fine").chunk(0))
            new = np.flatnonzero(np.r_[True, _changes([token, ca, cb])])
            for p, q in zip(new, np.r_[new[1:], len(token)]):
                kinds, number, sizes = np.unique(component[p:q], return_inverse=True, return_counts=True)
                if len(kinds) < 2:
                    continue
                own = np.arange(p, q)
                coarse = (small[own].reshape(-1, FINE // GROUPS, GROUPS).sum(axis=1, dtype=np.uint32)) << scale[own].astype(np.uint32)
                tree = CountTree(coarse, n[p:q])
                # The largest component asks nothing; every other member asks the whole tree.
                for i in np.flatnonzero(number != sizes.argmax()):
                    near = tree.near(coarse[i], int(n[p + i]), percent)
                    near = near[(number[near] != number[i]) & ((number[near] == sizes.argmax()) | (near > i))]
                    if ca[p] != cb[p]:
                        near = near[block[p + near] != block[p + i]]
                    if len(near):
                        most = np.concatenate([_fine_overlap(small, scale, own[i], own[near[k : k + 500]]) for k in range(0, len(near), 500)])
                        near = near[most >= least_overlap(n[p + i], n[p + near], percent)]
                    if len(near):
                        yield _pair_batch(np.full(len(near), rep[p + i]), rep[p + near], PAIR)
    return rows


def _shared_rows(block: int):
    """Rows (token, rep), sorted so, whose token has another row, and (token, count) of tokens of more than
    `block` rows. One row is held over between batches."""
    def hot(tokens, counts) -> pa.RecordBatch:
        over = np.asarray(counts) > block
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(tokens)[over], pa.int64()), pa.nulls(over.sum(), pa.int64()), pa.array(np.asarray(counts)[over], pa.int64())], ["token", "rep", "count"])

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int64())], ["token", "rep", "count"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, twice, run = None, False, 0
        for batch in trimmed(batches):
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0] if last is not None else batch
            token = batch.column("token").to_numpy()
            same = token[1:] == token[:-1]
            keep = np.r_[twice, same] | np.r_[same, False]
            last, twice = batch.slice(batch.num_rows - 1), bool(same[-1]) if len(same) else twice
            yield plain(batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1])))
            # `run` rows of the first token came before this batch; the last row comes again with the next.
            new = np.flatnonzero(np.r_[True, ~same])
            counts = np.diff(np.r_[new, len(token)])
            counts[0] += run
            run = int(counts[-1]) - 1
            yield hot(token[new[:-1]], counts[:-1])
        if last is not None and twice:
            yield plain(last)
            yield hot(last.column("token").to_numpy(), [run + 1])
    return rows


def _sets_of(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column("text"))
            for i, j in parts(offsets):
                sets = list(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                fine = pa.array([packed_fine(np.bincount((s % np.uint64(FINE)).astype(np.int64), minlength=FINE)) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists, fine], ["rep", "tokens", "fine"])
    return rows


def _fine_pairs(percent: int):
    """Pairs that the bound by finer vectors leaves."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = []
            for i in range(0, batch.num_rows, 2000):
                (va, sa), (vb, sb) = (_finer(batch.column(c).slice(i, 2000)) for c in ("va", "vb"))
                both = np.minimum(va.astype(np.uint32) << sa.astype(np.uint32), vb.astype(np.uint32) << sb.astype(np.uint32))
                keep.append(both.sum(axis=1, dtype=np.int64) >= least_overlap(na[i : i + 2000], nb[i : i + 2000], percent))
            if keep:
                yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))
    return rows


def verified(pairs: DataFrame, sets: DataFrame, percent: int, broadcast_ids: int) -> DataFrame:
    """Pairs (a, b), of a written table, whose whole sets are similar enough; the finer bound goes before."""
    def met(pairs: DataFrame, columns: dict) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        asked = sets.join(few(ends, broadcast_ids), "rep", "left_semi")
        for side in ("b", "a"):
            held = asked.select(F.col("rep").alias(side), *[c.alias(f"{n}{side}") for n, c in columns.items()])
            pairs = pairs.hint("merge").join(held.hint("merge"), side)
        return pairs

    close = met(pairs, {"n": F.size("tokens").cast("long"), "v": F.col("fine")}).mapInArrow(_fine_pairs(percent), "a long, b long")
    both = met(staged(close, "close_pairs"), {"t": F.col("tokens")})
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.filter(100 * shared >= percent * (F.size("ta") + F.size("tb") - shared)).select("a", "b").distinct()


def _parts_for(count, block: int):
    """A power of two of parts that hold about `block` of `count` rows each at most."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(count / block, F.lit(1.0))))).cast("long")


def dealt(rows: DataFrame, hot: DataFrame, block: int) -> DataFrame:
    """`rows` (token, rep, ...) with `part`: -1, and of the tokens in `hot` (token, count) a part by hash. Tokens of
    one order deal alike, so that a member has no more leaders than there are orders."""
    many = hot.select("token", _parts_for(F.col("count"), block).alias("parts"))
    part = F.pmod(F.xxhash64("rep", F.pmod("token", F.lit(ORDERS))), F.col("parts"))
    return rows.join(many, "token", "left").withColumn("part", F.coalesce(part, F.lit(-1))).drop("parts")


def cells(members: DataFrame, percent: int, block: int, broadcast_ids: int) -> DataFrame:
    """token, ca, cb, block, rep of hot buckets' members (token, rep, n, component): cells of one or two blocks
    with all pairs of different components whose sizes are near enough."""
    per = staged(members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size")), "hot_components")
    giant = per.groupBy("token").agg(F.max(F.struct("size", "component"))["component"].alias("giant"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds")
    # A hair wider than the ratio of linked sizes, so that no rounding puts a pair two classes apart.
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    asked = members.join(few(staged(giant, "giants"), broadcast_ids), "token")
    asked = asked.select("token", "rep", F.floor(F.log("n") / width).cast("long").alias("kind"), (F.col("component") != F.col("giant")).cast("long").alias("asks"))
    kinds = asked.groupBy("token", "kind", "asks").agg(F.count(F.lit(1)).alias("count"))
    kinds = staged(kinds.select("token", "kind", "asks", _parts_for(F.col("count"), block).alias("parts")), "hot_kinds")
    name = lambda slot: (F.col("kind") * 2 + F.col("asks")) * (1 << 40) + slot
    blocks = kinds.select("token", "kind", "asks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slot"))
    blocks = staged(blocks.select("token", "kind", "asks", name(F.col("slot")).alias("block")), "hot_blocks")
    a, b = (blocks.select("token", *[F.col(c).alias(f"{c}{side}") for c in ("kind", "asks", "block")]) for side in "ab")
    met = a.join(b, "token").filter("blocka <= blockb and abs(kinda - kindb) <= 1 and asksa + asksb > 0")
    ends = met.select("token", F.col("blocka").alias("ca"), F.col("blockb").alias("cb")).withColumn("block", F.explode(F.array_distinct(F.array("ca", "cb"))))
    placed = asked.join(few(kinds, broadcast_ids), ["token", "kind", "asks"]).select("token", "rep", name(F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))
    return placed.join(ends, ["token", "block"]).select("token", "ca", "cb", "block", "rep")


def _texts_of(texts: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Texts of the ids; past the bound of the broadcast, texts and ids are merged."""
    small = ids.count() <= most
    return (texts if small else texts.hint("merge")).join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("rep"), "left_semi")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, small: int = 16, frequent: int = 1 << 18, broadcast_ids: int = 1 << 20, block: int = 1 << 12) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (least id reachable by links), xx (hash of its text).

    Ids of whole numbers are used as they are; others go by their rank.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("xx", F.xxhash64("text"))
    if not isinstance(texts.schema["doc_id"].dataType, T.IntegralType):
        names = staged(ranked(texts.select("doc_id").filter("doc_id is not null").distinct(), "doc_id"), "ids").select(F.col("doc_id").alias("name"), F.col("rank").cast("long").alias("key"))
        keyed = texts.hint("merge").join(names, F.col("doc_id") == F.col("name"), "left").select(F.col("key").alias("doc_id"), "text")
        found = similar_components(keyed, "doc_id", "text", size, percent, small, frequent, broadcast_ids, block)
        for column in ("doc_id", "component_id"):
            named = names.select(F.col("key").alias(f"{column}_key"), F.col("name").alias(f"{column}_name"))
            found = found.join(named, F.col(column) == F.col(f"{column}_key"), "left")
        return found.select(F.col("doc_id_name").alias("doc_id"), "n_shingles", F.col("component_id_name").alias("component_id"), "xx")
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
    survey = staged(texts.mapInArrow(_survey(size, 3), "doc_id long, xx long, n long, c1 long, c2 long, vector binary, token long, count long"), "survey")
    described = survey.filter("n is not null")
    order = spark.sparkContext.broadcast(frequent_shingles(survey.filter("token is not null").select("token", "count"), frequent))
    classes = staged(described.filter("n > 0 and doc_id is not null").groupBy(*CLASS).agg(F.min("doc_id").alias("rep"), F.first("vector").alias("vector")), "classes")
    # Prefixes carry the id of some class member; `points` names the representative.
    tokens = texts.filter("doc_id is not null").mapInArrow(_prefixes(size, percent, order), "token long, rep long")
    shared = staged(tokens.repartition("token").sortWithinPartitions("token", "rep").mapInArrow(_shared_rows(block), "token long, rep long, count long"), "shared")
    points = classes.select(*CLASS, "rep", "vector")
    points = staged(described.select("doc_id", *CLASS).hint("merge").join(points, CLASS).select("doc_id", F.col("rep").alias("own"), "n", F.col("vector")), "points")
    hot = shared.filter("count is not null").select("token", "count")
    met = shared.filter("count is null").hint("merge").join(points, F.col("rep") == F.col("doc_id")).select("token", F.col("own").alias("rep"), "n", "vector")
    any_hot = not hot.isEmpty()
    met = dealt(met, few(hot, broadcast_ids), block) if any_hot else met.withColumn("part", F.lit(-1).cast("long"))
    sorted_ = lambda df, keys: df.repartition(*keys).sortWithinPartitions(*keys, "rep")
    pair_rows = "a long, b long, kind int"
    found = sorted_(met, PART).mapInArrow(_leaders(percent, small), pair_rows)
    found = staged(found.groupBy("a", "b", (F.col("kind") >= MEMBER).alias("member")).agg(F.max("kind").alias("kind")), "pairs")
    pairs = found.filter("not member").select("a", "b", (F.col("kind") == FIRST).alias("first"))
    crowd = found.filter("member").select(F.col("a").alias("token"), F.col("b").alias("rep"), (F.col("kind") == HOT).alias("hot"))
    # Whole sets of every representative that a later step may verify.
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(crowd.select("rep")).distinct(), "ids")
    sets = staged(_texts_of(texts, ids, broadcast_ids).mapInArrow(_sets_of(size), "rep long, tokens array<long>, fine binary").filter(F.size("tokens") > 0), "sets")
    links = staged(verified(pairs.filter("first").select("a", "b"), sets, percent, broadcast_ids), "first_links")
    held = components(links)
    known = lambda name: held.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))
    members = sets.select("rep", F.size("tokens").cast("long").alias("n"), "fine").join(known("rep"), "rep", "left").withColumn("component", F.coalesce("rep_component", "rep"))
    alone = F.lit(-1).cast("long")
    places = crowd.filter("not hot").select("token", alone.alias("ca"), alone.alias("cb"), alone.alias("block"), "rep")
    if any_hot:
        light = staged(crowd.filter("hot").hint("merge").join(members.drop("fine"), "rep").select("token", "rep", "n", "component"), "hot_members")
        places = places.unionByName(cells(light, percent, block, broadcast_ids))
    crowd = places.hint("merge").join(members, "rep").select(*CELL, "block", "rep", "n", "component", "fine")
    across = sorted_(crowd, CELL).mapInArrow(_across(percent), pair_rows)
    more = pairs.filter("not first").select("a", "b").unionByName(across.select("a", "b")).distinct().join(pairs.filter("first").select("a", "b"), ["a", "b"], "left_anti")
    more = more.join(known("a"), "a", "left").join(known("b"), "b", "left").filter(F.coalesce("a_component", "a") != F.coalesce("b_component", "b"))
    more = staged(more.select("a", "b"), "more_pairs")
    links = links.unionByName(staged(verified(more, sets, percent, broadcast_ids), "more_links"))
    final = staged(components(links), "components")
    named = classes.select(*CLASS, "rep").join(final, F.col("rep") == F.col("node"), "left").select(*CLASS, F.coalesce("component", "rep").alias("component_id"))
    joined = described.select("doc_id", "xx", *CLASS).join(staged(named, "class_components"), CLASS, "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "xx")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each component, the one of least id, columns unchanged. Rows
    are looked up by id and text."""
    found = similar_components(docs, id_col, text_col, **options)
    others = staged(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("other"), F.col("xx").alias("x")).distinct(), "others")
    held = as_rows(docs).withColumn("w", F.xxhash64(text_or_empty(f"row.{text_col}"))).hint("merge")
    return held.join(others, (F.col(f"row.{id_col}") == F.col("other")) & (F.col("w") == F.col("x")), "left_anti").select("row.*")
