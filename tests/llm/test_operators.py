"""Each operator against a plain restatement of its contract, with odd rows and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict
from random import Random

import pytest

from tests.llm import restated
from strata.llm import chat_format, exact_dedup, graph, line_dedup, mixing, ngram_join, quality_rules, secret_scan, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 2, "assistant", "b\\"), (1, 0, "system", None), (1, 1, "user", "<|im_end|>\\<|x"),
            (1, 3, "assistant", "é😀"), (1, 4, None, "<|im_next|>"), (1, None, "user", ""), (None, 0, "assistant", "[INST]"), (2, 0, "u<|im_sep|>", "t"), (2, 0, "a", "t"), (2, 0, "a", "t"),
            (3, 0, "assistant", "long " * 50_000), (4, 5, "assistant", "one"), (4, 6, "assistant", "two"), (4, 7, "user", "<<SYS>><s>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = []
    for conv, turns in groups.items():
        turns.sort()
        learnt = "".join(t[3] for t in turns if t[2] == "assistant")
        want.append((conv, len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learnt), sha(learnt)))
    found = chat_format.format_conversations(df)
    same(chat_format.digest(found).drop("formatted_chars"), want)
    text = {r.conv_id: r.formatted for r in found.collect()}
    assert text[4] == "<|im_start|>assistant<|im_sep|>one<|im_next|>two<|im_end|><|im_start|>user<|im_sep|><\\<SYS>><\\s><|im_end|>"
    assert not re.search(r"</?s>|\[/?INST\]", text[-1])
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    inside = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(frame, corpus):
    rows = corpus + [(1000 + i, "#$ <b> & | % *\n" + "junk " * 30, "en", "bad") for i in range(40)]
    found = quality_rules.quality_rules(frame(rows))
    want = []
    for doc, text, _, source in rows:
        m = measures(text)
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        want.append((doc, *m, failed))
    same(found.drop("host_ok", "kept"), want)
    got = {r.doc_id: r for r in found.collect()}
    assert not got[1000].host_ok and not got[1000].kept  # nearly all of its host fails
    assert got[5].host_ok and got[5].kept
    kept = quality_rules.keep_good(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found.collect() if r.kept)
    assert quality_rules.quality_rules(frame(rows).limit(0)).count() == 0


def test_small_hosts_shrink_to_the_mean(frame):
    good, junk = " ".join(f"w{i}" for i in range(60)), "a b"
    rows = [(i, good, "en", f"h{i % 20}") for i in range(400)] + [(500, junk, "en", "tiny")] + [(600 + i, junk, "en", "farm") for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(rows), host_limit=0.9).collect()}
    assert got[500].base_failed and got[500].host_ok  # one failure says little of a host
    assert not got[600].host_ok


@pytest.mark.parametrize("shard_words", [200, 50_000])
def test_mixing(frame, corpus, shard_words):
    size = {i: len(WORD.findall(r[1] or "")) for i, r in enumerate(corpus)}
    totals = defaultdict(int)
    for i, r in enumerate(corpus):
        totals[r[3]] += size[i]
    totals = dict(sorted(totals.items(), key=lambda x: (x[0] is None, x[0] or "")))
    target = restated.targets(totals)
    rows = mixing.mix(frame(corpus), shard_words=shard_words, block_words=4).collect()
    assert len(rows) == len(corpus)
    taken = Counter()
    for r in rows:
        assert r.size == len(WORD.findall(dict((x[0], x[1]) for x in corpus)[r.doc_id] or ""))
        assert r.source_size == totals[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 4 * max(1, totals[s] // shard_words + 1)
    want, _ = restated.mixed([(r[0], r[1], r[3]) for r in corpus], 4, shard_words)
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r[0], n) for r, n in zip(corpus, want))
    again = mixing.mix(frame(corpus[::-1]), shard_words=shard_words, block_words=4).collect()
    assert Counter(again) == Counter(rows)
    assert mixing.mix(frame(corpus[:2]).limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(frame([(1, None, None, None), (2, "", "en", "a")])).collect()} == {0}


def test_highest_quotients(spark):
    """Quotas are those of Sainte-Lague's quotients taken one by one."""
    words = {"a": 1000, "b": 370, "c": 90, "d": 41, "e": 41, "f": 3}
    cells = spark.createDataFrame([(k, False, 0, w, w * 1.5) for k, w in words.items()], "skey string, snull boolean, shard long, words long, target double")
    got = {r.skey: r.quota for r in mixing.apportion(cells, 10).collect()}
    want, cap = Counter(), {k: -(-2 * w // 10) for k, w in words.items()}
    for _ in range(round(sum(words.values()) * 1.5 / 10)):
        best = max((k for k in words if want[k] < cap[k]), key=lambda k: (words[k] * 1.5 / (2 * want[k] + 1), [-ord(k)]))
        want[best] += 1
    assert got == {k: want[k] for k in words}


def test_line_dedup(frame, corpus):
    held = defaultdict(set)
    key = lambda line: lowered(line.strip(SPACES))
    for doc, text, *_ in corpus:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc)
    want = []
    for doc, text, *_ in corpus:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(held[key(x)]) >= 3 and doc != max(held[key(x)]))]
        want.append((doc, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    found = line_dedup.digest(line_dedup.line_dedup(frame(corpus)))
    same(found, want)
    assert sum(x[2] for x in want) > 20
    assert line_dedup.line_dedup(frame(corpus).limit(0)).count() == 0


def test_line_dedup_null_id(frame):
    line = "a line of more than twenty characters"
    got = line_dedup.line_dedup(frame([(None, line, "en", "s"), (1, line, "en", "s"), (2, line.upper() + " ", "en", "s")])).collect()
    assert sorted((str(r.doc_id), r.n_dropped) for r in got) == [("1", 1), ("2", 0), ("None", 1)]


@pytest.mark.parametrize("huge", [8 << 20, 64])
def test_exact_dedup(frame, corpus, huge):
    rows = corpus + [(None, corpus[5][1], None, None), (None, "only null", None, None), (2000, "x" * 5000, "en", "s"), (2001, "x" * 5000, "en", "s"), (2002, "x" * 4999 + "y", "en", "s")]
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    found = exact_dedup.exact_dedup(frame(rows), huge_bytes=huge)
    want, seen = [], set()
    for doc, text, *_ in rows:
        ids = [d for d in groups[text or ""] if d is not None]
        keep = max(ids) if ids else None
        kept = doc == keep and (text or "", doc) not in seen
        seen.add((text or "", doc))
        want.append((doc, keep, len(groups[text or ""]), kept, sha(text or "")))
    same(found, want)
    kept = exact_dedup.keep_first(frame(rows), )
    assert kept.columns == frame(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[3])
    assert exact_dedup.exact_dedup(frame(rows).limit(0)).count() == 0


def test_fingerprints_compose(spark):
    """Parts of any length combine to the fingerprint of the whole."""
    import numpy as np
    data = np.frombuffer(bytes(range(256)) * 60, np.uint8)
    whole = [int(x[0]) for x in exact_dedup.fingerprint_bytes(data, np.array([0, len(data)]))]
    for cut in (0, 1, 4095, 4096, 9000, len(data)):
        n, h1, h2, p1, p2 = ([int(v) for v in x] for x in exact_dedup.fingerprint_bytes(data, np.array([0, cut, len(data)])))
        got = [sum(n)] + [(h[0] + h[1] * p[0]) % m for h, p, m in ((h1, p1, exact_dedup.PRIMES[0]), (h2, p2, exact_dedup.PRIMES[1]))]
        assert got == whole[:3]


def test_colliding_fingerprints_are_told_apart(frame, monkeypatch):
    """Chunks of one fingerprint that differ split the group."""
    rows = frame([(1, "aaa", "en", "s"), (2, "aab", "en", "s"), (3, "aaa", "en", "s")])
    real = exact_dedup.fingerprints

    def weak(*args):
        from pyspark.sql import functions as F
        return real(*args).withColumns({"h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long")})
    monkeypatch.setattr(exact_dedup, "fingerprints", weak)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


def test_secret_scan(frame, corpus):
    r = Random(4)
    letters = secret_scan.DIGITS + secret_scan.UPPER + secret_scan.LOWER
    keys = ["".join(r.choice(letters) for _ in range(36)) for _ in range(40)]
    key, word = keys[0], "a1" * 20
    rows = corpus + [(3000, f"password = 'hunter22' token: abc AKIA{'Z' * 16}Q {'0a' * 12}", "en", "s"), (3001, f"secret=token:abcdefg api-key=12345678 é {key}", "en", "s"),
                     *[(3100 + i, f"see {k}, then", "en", "s") for i, k in enumerate(keys[1:])], *[(3200 + i, f"{'xy12' * 8} x{i}", "en", "s") for i in range(30)],
                     (3002, f"API_KEY\"  :  \"{key}\" deadbeef{'f' * 16}\n{word}", "en", "s"), (3003, "AKIA" * 6 + " AKIAX passwd=a=b=c=d", "en", "s")]
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for doc, text, *_ in rows:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        counts = Counter(s[1] for s in spans)
        want.append((doc, counts[0], counts[1], counts[2], sha(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)))))
    scanned = secret_scan.secret_scan(frame(rows))
    base = {r.doc_id: [(x.start, x.end) for x in r.base_spans] for r in scanned.collect()}
    random = sorted((r.doc_id, x.start, x.end) for r in scanned.collect() for x in r.spans if x.kind == 3)
    assert random == sorted(restated.random_spans([(r[0], r[1]) for r in rows], secret_scan.TOKEN, secret_scan.ENCODINGS, secret_scan.CUTS, 0.1, base))
    found = secret_scan.digest(scanned)
    same(found.drop("spans"), want)
    spans = {r.doc_id: r.spans for r in found.collect()}
    found = sum(spans[3100 + i] == "random:4:40" for i in range(39))
    assert found >= 35  # keys in no assignment
    assert not any(spans[3200 + i] for i in range(30))
    assert "random" not in spans[3002]  # inside an assignment, and a regular token
    assert secret_scan.digest(secret_scan.secret_scan(frame(rows).limit(0))).count() == 0


def test_randomness_separates(spark):
    from pyspark.sql import functions as F
    r = Random(1)
    keys = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    plain = ["".join(sorted(k)) for k in keys[:100]] + [k[:8] * 5 for k in keys[:100]]
    df = spark.createDataFrame([(k, 1) for k in keys] + [(p, 0) for p in plain], "t string, y int")
    p = df.select("y", secret_scan.randomness(F.col("t"), F.lit("0123456789abcdef")).alias("p"))
    passed = {x.y: x.n for x in p.filter("p > 0.05").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert passed[1] > 180 and passed.get(0, 0) < 10


def shingles(text):
    w = WORD.findall(lowered(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(frame, corpus):
    rows = corpus + [(None, corpus[0][1], None, None), (4000, "a b", "en", "s"), (4001, "A  b", "en", "s"), (4002, "a c", "en", "s")]
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = [(r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows)]
    for small in (16, 3):
        same(ngram_join.similar_components(frame(rows), small=small).drop("xx"), want)
    assert len({w[2] for w in want}) < len(want) * 0.8
    one = ngram_join.keep_one(frame(rows))
    assert one.columns == frame(rows).columns
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(str(w[0]) for w in want if w[0] is None or w[0] == w[2])
    assert ngram_join.similar_components(frame(rows).limit(0)).count() == 0


def brute_components(rows, sets):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [rows[find(i)][0] for i in range(len(rows))]


def test_ngram_join_of_hot_buckets(frame):
    r = Random(8)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    rows = []
    for i in range(240):
        text = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            text[r.randrange(8, len(text))] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(text[: r.randint(40, 60)]), "en", "s"))
    rows += [(300 + i, " ".join(base[:5] + [f"y{i}" for _ in range(i % 4)]), "en", "s") for i in range(40)]
    sets = [shingles(x[1]) for x in rows]
    want = [(x[0], len(s), c) for x, s, c in zip(rows, sets, brute_components(rows, sets))]
    assert 3 < len({w[2] for w in want}) < 200
    for small, block in ((3, 8), (16, 40)):
        same(ngram_join.similar_components(frame(rows), small=small, block=block).drop("xx"), want)


def test_no_hot_bucket_is_one_task(spark):
    r = Random(4)
    near = [(1, i, r.randint(10, 60), r.choice([7, 7, 7, 8, 9, 1000 + i])) for i in range(1500)]
    df = spark.createDataFrame(near + [(2, 5, 20, 7), (2, 6, 20, 8), (3, 1, 20, 7), (3, 2, 20, 7)], "token long, rep long, n long, component long")
    parts = ngram_join.dealt(df, spark.createDataFrame([(1, 1500)], "token long, count long"), 100).groupBy("token", "part").count().collect()
    assert max(p["count"] for p in parts) <= 200 and sum(p["count"] for p in parts) == 1504 and all((p.part < 0) == (p.token > 1) for p in parts)
    held = defaultdict(list)
    for c in ngram_join.cells(df, 80, 100, 1000).collect():
        held[c.token, c.ca, c.cb].append((c.rep, c.block))
    assert max(map(len, held.values())) <= 400 and {k[0] for k in held} == {1, 2}
    met = {(min(a, b), max(a, b)) for (token, ca, cb), rows in held.items() if token == 1 for a, x in rows for b, y in rows if a != b and (ca == cb or x != y)}
    asked = {(a[1], b[1]) for a in near for b in near if a[1] < b[1] and a[3] != b[3] and 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2])}
    assert asked <= met


def test_count_tree_loses_no_point():
    import numpy as np
    rng = np.random.default_rng(2)
    sets = [set(rng.choice(600, rng.integers(5, 90), replace=False).tolist()) for _ in range(300)]
    sets += [set(list(s)[: max(1, len(s) - 1)]) for s in sets[:60]]
    v = np.array([np.bincount([x % ngram_join.GROUPS for x in s], minlength=ngram_join.GROUPS) for s in sets], np.uint16)
    sizes = np.array([len(s) for s in sets])
    tree = ngram_join.CountTree(v, sizes)
    for i, s in enumerate(sets):
        linked = {j for j, o in enumerate(sets) if 100 * len(s & o) >= 80 * len(s | o)}
        assert linked <= set(tree.near(v[i], int(sizes[i]), 80).tolist())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 200), (200, 300), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_windows(rows, size):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(b[s : s + size] for _, b in texts for s in range(len(b) - size + 1))
    for doc, b in texts:
        mark = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                mark[s : s + size] = b"\1" * size
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        yield doc, len(b), sum(mark), runs, sha(bytes(x for x, m in zip(b, mark) if not m))


def test_suffix_dedup(frame, corpus):
    rows = [r for r in corpus if r[0] not in (905, 906)] + [(None, corpus[9][1], None, None), (5000, "a" * 150, "en", "s"), (5001, "ab" * 90, "en", "s"), (5002, "x" + "ab" * 40, "en", "s"), (5003, "a" * 59, "en", "s"), (5004, "q" * 60, "en", "s")]
    want = list(brute_windows(rows, 60))
    same(suffix_dedup.suffix_dedup(frame(rows), window=60).drop("kept", "kept_text"), want)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)
    assert suffix_dedup.suffix_dedup(frame(rows).limit(0)).count() == 0


def test_suffix_dedup_default_window(frame, corpus):
    rows = [r for r in corpus if r[0] < 60] + [(905, "word " * 300, "en", "s")]
    same(suffix_dedup.suffix_dedup(frame(rows)).drop("kept", "kept_text"), list(brute_windows(rows, 400)))


def test_chats_of_many_turns(spark):
    """Time follows the turns in proportion; a text is read back at any place."""
    from pyspark.sql import functions as F
    n = 20_000
    role, text = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant"), F.concat(F.lit("é<s>"), "id")
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    got = chat_format.digest(chat_format.format_conversations(df)).first()
    learnt = "".join(f"é<s>{i}" for i in range(n) if i % 3)
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (n, len(learnt), sha(learnt))


def test_texts_of_many_matches(frame):
    text = " ".join(f"token={i:08d} {i:032x}" for i in range(5000))
    got = secret_scan.digest(secret_scan.secret_scan(frame([(1, text, "en", "s")]))).first()
    assert (got.n_assign, got.n_hex) == (5000, 5000)


def test_huge_texts(frame):
    """Texts of many segments and chunks; one byte at the end tells two apart."""
    big = "é0123456789abcde" * 1_000_000
    rows = frame([(1, big, "en", "s"), (2, big, "en", "s"), (3, big[:-1] + "f", "en", "s"), (4, "short", "en", "s")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True)}


def test_suffix_dedup_of_a_text_past_16_mib(frame):
    r = Random(2)
    text, passage = r.randbytes(9 << 20).hex(), r.randbytes(300).hex()
    at = (1 << 24) - 100
    text = text[:at] + passage + text[at:] + passage
    got = suffix_dedup.suffix_dedup(frame([(1, text, "en", "s"), (2, "x" + passage + "y", "en", "s")])).collect()
    assert {x.doc_id: (x.n_removed, x.n_spans) for x in got} == {1: (1200, 2), 2: (600, 1)}
    assert {x.doc_id: x.kept_text for x in got}[2] == "xy"


def test_kept_text_drops_cut_characters(frame):
    both = "shared passage that is long enough é"
    got = suffix_dedup.suffix_dedup(frame([(1, both, "en", "s"), (2, both[:-1] + "è", "en", "s")]), window=20).collect()
    assert {r.kept_text for r in got} == {""} and {r.n_bytes - r.n_removed for r in got} == {1}


def test_ngram_join_of_other_ids(spark, corpus):
    rows = [(f"k{d % 7}-{d}", t) for d, t, *_ in corpus]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    numbers = {name: i for i, name in enumerate(sorted({r[0] for r in rows}))}
    plain = spark.createDataFrame([(numbers[d], t) for d, t in rows], "doc_id long, text string")
    names = {i: name for name, i in numbers.items()}
    want = [(names[r.doc_id], r.n_shingles, names[r.component_id]) for r in ngram_join.similar_components(plain).collect()]
    same(ngram_join.similar_components(df).drop("xx"), want)
    one = ngram_join.keep_one(df)
    assert one.columns == ["doc_id", "text"] and 0 < one.count() < len(rows)


def test_rows_of_one_id_share_their_times(frame):
    many = [(5, " ".join(f"v{i}" for i in range(64)), "en", "s")] * 3 + [(6, " ".join(f"u{i}" for i in range(64)), "en", "s")]
    held = Counter(r.doc_id for r in mixing.keep_taken(frame(many)).collect())
    assert held[5] <= 6 and held[6] <= 2 and sum(held.values()) == 6


def test_whole_copies_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    held = mixing.keep_taken(docs).collect()
    words, times = Counter(), Counter((r.doc_id, r.text) for r in held)
    for r in held:
        words[r.source] += len(WORD.findall(r.text or ""))
    assert max(times.values()) <= 2
    for s, t in target.items():
        assert abs(words[s] - t) <= 0.02 * t
    got = restated.copies([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert Counter((r.doc_id, r.text, r.source) for r in held) == +got


def test_hot_ids_are_dealt_to_shards(spark):
    rows = [(None, "a b c d", "s")] * 900 + [(7, " ".join(f"v{i}" for i in range(40)), "s")] * 300 + [(7, f"only {i}", "s") for i in range(50)] + [(8, "", "s")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    dealt = mixing.pieces(df, shard_words=1000)
    assert dealt.filter("size > 0").groupBy("shard").sum("rows").count() > 8
    assert dealt.agg({"rows": "max"}).first()[0] <= 250
    want, _ = restated.mixed(rows, 16, 1000)
    assert Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(df, shard_words=1000).collect()) == Counter((d, restated.n_words(t), n) for (d, t, _), n in zip(rows, want))
    held = mixing.keep_taken(df).collect()
    assert abs(sum(restated.n_words(r.text) for r in held) - 1.5 * sum(restated.n_words(t) for _, t, _ in rows)) <= 40
    assert Counter((r.doc_id, r.text, r.source) for r in held) == +restated.copies(rows)


def test_long_text_in_a_mix(spark):
    rows = [(1, "long " * 400_000, "s"), (2, "a b c", "s"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, _ = restated.mixed(rows)
    assert {(r.doc_id, r.taken) for r in mixing.mix(df).collect()} == set(zip((1, 2, 3), want))


def test_language_sample_is_even(spark):
    from pyspark.sql import functions as F
    from strata.llm import language_id
    rows = spark.range(50_000).select(F.xxhash64("id").alias("h"), "id").repartition(40)
    got = language_id.sampled(rows, 300).collect()
    want = sorted(r.h for r in rows.collect())[:300]
    assert sorted(r.h for r in got) == want
