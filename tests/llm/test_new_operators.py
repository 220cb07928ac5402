"""Fill-in-the-middle, the suffix tree and spelling variants against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import fill_middle, shared, spelling, suffix_tree

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def rearranged(doc_id, text):
    units = UNIT.findall(text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or c % 100 >= 50:
        return len(units), "plain", None, None, text
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if d % 100 < 80 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), form, len(pre), len(mid), out


def test_fill_middle(frame, corpus):
    r = random.Random(3)
    more = [(1000 + i, "".join(r.choice(["a", " ", "\n", "é", "😀", "<", "P>", "S>", "<M", " "]) for _ in range(r.randrange(40))), "en", "s") for i in range(300)]
    more += [(2000 + i, f"say {m} here", "en", "s") for i, m in enumerate(("<P>", "<S>", "<M>"))] + [(None, "an id of none", "en", "s")]
    rows = corpus + more
    found = fill_middle.fill_middle(frame(rows))
    same(found, [(d, *rearranged(d, t or "")) for d, t, *_ in rows])
    assert {x.form for x in found.collect()} == {"plain", "psm", "spm"}
    same(fill_middle.digest(found), [(d, n, f, p, m, sha(out), sha(t or "")) for d, t, *_ in rows for n, f, p, m, out in [rearranged(d, t or "")]])
    assert fill_middle.digest(fill_middle.fill_middle(frame(rows).limit(0))).count() == 0


def test_fill_middle_of_long_texts(spark):
    texts = ["word " * 400_000, "x" * 3_000_000, " " * 1_000_000 + "é" * 900_000, "ab\n" * 500_000]
    rows = [(i, texts[i % 4]) for i in range(16)]
    got = fill_middle.digest(fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string")))
    same(got, [(d, n, f, p, m, sha(out), sha(t)) for d, t in rows for n, f, p, m, out in [rearranged(d, t)]])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \té😀"), max_size=60), st.integers(1, 9), st.data())
def test_rope_splits_anywhere(text, leaf, data):
    raw = text.encode()
    ends, _ = fill_middle.unit_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    rope = fill_middle.rope_of(raw, ends, leaf)
    units = UNIT.findall(text)
    assert (rope.units, rope.chars, fill_middle.flat(rope)) == (len(units), len(text), raw)
    k, c = data.draw(st.integers(0, len(units))), data.draw(st.integers(0, len(text)))
    left, right = fill_middle.split(rope, k)
    assert (fill_middle.flat(left).decode(), fill_middle.flat(right).decode()) == ("".join(units[:k]), "".join(units[k:]))
    assert (left.units, right.units, left.chars) == (k, len(units) - k, len("".join(units[:k])))
    left, right = fill_middle.split(rope, c, "chars")
    assert (fill_middle.flat(left).decode(), fill_middle.flat(right).decode()) == (text[:c], text[c:])


def test_long_texts_are_cut_at_white_space():
    texts = [b"", b"ab cd ef gh", b"x" * 30, b"", b"a b", b"one two three four five six "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    cuts, owner = shared.cut_long(data, offsets, 6)
    pieces = [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    for k, text in enumerate(texts):
        own = [p for p, o in zip(pieces, owner) if o == k]
        assert b"".join(own) == text and [w for p in own for w in p.split()] == text.split()
    assert len(owner) == len(pieces) > len(texts)


def tree_scores(rows, depth=2, least_share=1e-6, discount=0.5):
    """Scores by the definition, over dictionaries."""
    texts = [(d, WORD.findall(lowered(t or "")) + [None], zlib.crc32(str("" if d is None else d).encode()) % 7 == 2) for d, t, *_ in rows]
    train = [w for _, w, held in texts if not held]
    counts = Counter(x for w in train for x in w)
    every = Counter(x for _, w, _ in texts for x in w)
    n, v = sum(counts.values()), len(counts)
    root = lambda w: (counts[w] + 1) / (n + v + 1)
    least = max(2, math.ceil(least_share * n))
    common = {w for w, c in every.items() if w is not None and c >= max(2, math.ceil(least_share * (sum(every.values()) - len(texts))))} | {None}
    grams = {1: {(w,): counts[w] for w in common}}
    for k in range(2, depth + 2):
        found = Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1))
        grams[k] = {g: c for g, c in found.items() if c >= least and set(g) <= common}
    tree = {}  # context -> (symbols' probabilities, rest)

    def probability(context, w):
        p = 1.0
        for k in range(min(depth, len(context)), 0, -1):
            state = tree.get(tuple(context[len(context) - k :]))
            if state:
                if w in state[0]:
                    return p * state[0][w]
                p *= state[1]
        return p * root(w)

    for k in range(1, depth + 1):
        by_context = defaultdict(dict)
        for g, c in grams[k + 1].items():
            by_context[g[:-1]][g[-1]] = c
        new = {}
        for context, symbols in by_context.items():
            total = grams[k][context]
            rest = 1 - sum(c - discount for c in symbols.values()) / total
            q = {w: probability(context[1:], w) for w in symbols}
            p = {w: (c - discount) / total + rest * q[w] for w, c in symbols.items()}
            gain = sum(p[w] * math.log(p[w] / q[w]) for w in p) + max(0.0, 1 - sum(p.values())) * math.log(rest)
            if total * gain >= len(p) * 0.5 * math.log(max(n, 2)):
                new[context] = p, rest
        tree.update(new)
    out = []
    for d, w, held in texts:
        out.append((d, held, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10(root(x)) for x in w), sum(math.log10(probability(w[max(0, i - depth) : i], x)) for i, x in enumerate(w))))
    return out, tree, probability, [*counts, "never seen"]


def check_scores(df, want):
    got = sorted(map(tuple, df.collect()), key=lambda r: (str(r[:5]), r[5]))
    want = sorted(want, key=lambda r: (str(r[:5]), r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("depth, share", [(2, 1e-6), (1, 1e-6), (2, 2e-3)])
def test_suffix_tree(frame, corpus, depth, share):
    rows = corpus + [(None, "w1 W2 w3", "en", "s"), (7, "unheard-of w1", "en", "s")]
    want, tree, *_ = tree_scores(rows, depth, share)
    assert {len(c) for c in tree} == set(range(1, depth + 1))
    check_scores(suffix_tree.suffix_tree_scores(frame(rows), depth=depth, least_share=share), want)


def test_states_of_the_tree_are_distributions(corpus):
    _, tree, probability, words = tree_scores(corpus)
    for context in list(tree)[:50] + [()]:
        assert sum(probability(context, w) for w in words) == pytest.approx(1)


def test_suffix_tree_beats_its_root_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffix_tree.suffix_tree_scores(docs).filter("held_out").groupBy().sum("base_score", "score", "n_tokens").first()
    assert got[1] - got[0] > 0.1 * got[2]


def test_suffix_tree_without_rows_and_with_held_out_alone(frame):
    assert suffix_tree.suffix_tree_scores(frame([]).limit(0)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    check_scores(suffix_tree.suffix_tree_scores(frame([(held, "a b", "en", "s"), (held, None, "en", "s")])), [(held, True, 3, 0, 0, 0.0, 0.0), (held, True, 1, 0, 0, 0.0, 0.0)])


def test_suffix_tree_reads_long_texts_whole(spark):
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "x" * 50]) for _ in range(150_000))
    rows = [(1, long), (2, "beta gamma"), (3, "y" * 2_000_000), (4, None), (5, long[:1000])]
    want, *_ = tree_scores([(d, t) for d, t in rows])
    check_scores(suffix_tree.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string")), want)


def variants(rows, least_chars=7, least_count=2, factor=10):
    counts = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_chars and c >= least_count}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return [(w, form[w], root(w), n[w], n_near[w], n.get(form[w])) for w in n]


def spelled(seed):
    """Words with variants of variants, repeated letters, accents, and many words of one shape."""
    r = random.Random(seed)
    rows, bases = [], ["banana" * 2, "aaaaaaaaa", "mississippi", "façade été".replace(" ", ""), "ÀÉÎÕÜßñ", "kingdom", "strengths", "abcdefg"]
    bases += ["shape" + "".join(r.choice("xyzw") for _ in range(4)) for _ in range(60)]
    for b in bases:
        words = [b] * 1200 if b in bases[:8] else [b] * 2
        for _ in range(40 if b in bases[:8] else 2):
            at = r.randrange(len(b))
            v = r.choice([b[:at] + b[at + 1 :], b[:at] + r.choice("abxé") + b[at:], b[:at] + r.choice("abxé") + b[at + 1 :]])
            words += [v] * r.choice([2, 3, 30, 110]) + [v[:-1] + r.choice("ab")] * r.choice([0, 2])
        r.shuffle(words)
        rows += [(len(rows) + i, " ".join(words[i * 50 : i * 50 + 50]).title() + "-x", "en", "s") for i in range(len(words) // 50 + 1)]
    return rows


@pytest.mark.parametrize("hot", [256, 3])
def test_spelling_variants(frame, corpus, hot):
    rows = spelled(4) + corpus + [(None, "kingdom kingdoms kingdoms", "en", "s")]
    want = variants(rows)
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 5 for w in want)
    same(spelling.spelling_variants(frame(rows), hot=hot), want)


def test_spelling_of_odd_tables(frame, spark):
    assert spelling.spelling_variants(frame([]).limit(0)).count() == 0
    assert spelling.spelling_variants(frame([(1, None, "en", "s"), (2, "", "en", "s"), (3, "short 1234567", "en", "s")])).count() == 0
    long = "letters " * 300_000 + "lettersx " * 3
    rows = [(1, long), (1, "q" * 1_000_000), (1, "q" * 1_000_000)]
    same(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")), variants(rows))


def test_bigram_order_is_by_frequency(spark):
    words = spark.createDataFrame([("aaaaaab",), ("bbbbbbb",)], "word string")
    places = spelling.gram_order(words)
    at = lambda g: places[spelling.LETTERS.index(g[0]) * len(spelling.LETTERS) + spelling.LETTERS.index(g[1])]
    assert at("ba") < at("ab") < at("aa") < at("bb") == len(places) - 1
