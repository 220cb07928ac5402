"""Plain restatements of operators that SQL cannot express."""

import math
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HALF = 1 << 63


def spark_hash(*values):
    """xxhash64 as Spark chains it: whole numbers of 8 bytes, numbers given as ("int", x) and booleans of 4."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else struct.pack("<i", int(v[1] if isinstance(v, tuple) else v)) if isinstance(v, (bool, tuple)) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - 2 * HALF if h >= HALF else h


def n_words(text):
    return len(WORD.findall(text or ""))


def targets(sizes):
    """Targets of sources, in order, by the stated rounds."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), list(sizes)
    while free:
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * unit > 2 * sizes[s]]
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else weights[s] * unit
        if not over:
            break
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    return target


def mixed(rows, block=16, shard_words=50_000, seed=("int", 7)):
    """Words taken by each row (doc_id, text, source), in order, and of each shard its pieces (key, size, rows, taken, piece)."""
    size = [n_words(t) for _, t, _ in rows]
    totals = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        totals[s] += n
    totals = dict(sorted(totals.items(), key=lambda x: (x[0] is None, x[0] or "")))
    target, cells, alike = targets(totals), defaultdict(list), defaultdict(list)
    for i, (d, t, s) in enumerate(rows):
        alike[d, t or "", s].append(i)
    for (d, t, s), held in alike.items():
        each = max(1, shard_words // max(size[held[0]], 1))
        for p in range(0, len(held), each):
            part = held[p : p + each]
            cells[s is None, s or "", spark_hash(seed, d, spark_hash(t), p // each) % max(1, -(-totals[s] // shard_words))].append((d, t, part, p // each, size[part[0]] * len(part)))
    words = {c: sum(x[4] for x in held) for c, held in cells.items()}
    source = lambda c: None if c[0] else c[1]
    want = {c: target[source(c)] * words[c] / totals[source(c)] if totals[source(c)] else 0.0 for c in cells}
    cap, quota = {c: -(-2 * w // block) for c, w in words.items()}, dict.fromkeys(sorted(cells), 0)
    for _ in range(min(round(sum(want.values()) / block), sum(cap.values()))):
        best = max((c for c in quota if quota[c] < cap[c]), key=lambda c: want[c] / (2 * quota[c] + 1))
        quota[best] += 1
    taken, shards = [0] * len(rows), defaultdict(list)
    for c, held in cells.items():
        order = sorted((x for x in held if x[4]), key=lambda x: (spark_hash(seed, "order", x[0], spark_hash(x[1]), x[3]), x[0] is not None, x[0] or 0, spark_hash(x[1]), x[3]))
        whole = min(quota[c] * block, 2 * words[c])
        rounds = whole // words[c] if words[c] else 0
        first = spark_hash(seed, "start", c[1], c[0], c[2]) % max(1, -(-words[c] // block)) * block
        last, begin = first + whole - rounds * words[c], 0
        for d, t, part, piece, own in order:
            over = lambda a, b: max(0, min(begin + own, b) - max(begin, a))  # noqa: E731, B023
            got = rounds * own + over(first, last) + over(0, last - words[c])
            begin += own
            for j, i in enumerate(part):
                taken[i] = (j + 1) * got // len(part) - j * got // len(part)
            shards[c].append(((d, t, source(c)), own // len(part), len(part), got, piece))
    return taken, shards


def copies(rows):
    """Of each (doc_id, text, source) how often the mix holds it in whole texts."""
    out = Counter()
    for held in mixed(rows)[1].values():
        left, least = 0, {}
        for k, (_, size, _, got, _) in enumerate(held):
            least[k] = got // size
            left += got % size
        order = sorted(range(len(held)), key=lambda k: (held[k][3] % held[k][1] == 0, -held[k][1], spark_hash(held[k][0][0], spark_hash(held[k][0][1]), held[k][4])))
        for k in order:
            more = min(left // held[k][1], 2 * held[k][2] - least[k])
            least[k] += more
            left -= more * held[k][1]
        free = [k for k in order if least[k] < 2 * held[k][2]]
        if left and free:
            last = min(free, key=lambda k: held[k][1])
            other, over = {**least, last: least[last] + 1}, held[last][1] - left
            for k in sorted(order, key=lambda k: (-held[k][1], spark_hash(held[k][0][0], spark_hash(held[k][0][1]), held[k][4]))):
                if k != last:
                    less = min(over // held[k][1], other[k])
                    other[k] -= less
                    over -= less * held[k][1]
            least = other if over < left else least
        for k, n in least.items():
            out[held[k][0]] += n
    return out


def good(rows, measures, limit=0.5):
    """Whether the quality rules keep each row (doc_id, text, source)."""
    found = [measures(t) for _, t, _ in rows]
    fails = [[m[0] < 10, 100 * m[4] > 20 * m[0], 10 * m[2] > m[0], 10 * m[3] > m[0], m[1] < 2 * m[0] or m[1] > 15 * m[0]] for m in found]
    hosts = defaultdict(list)
    for (_, _, s), f in zip(rows, fails):
        hosts[s].append(f)
    bad = set()
    for rule in range(5):
        rate = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in hosts.items()}
        mean = sum(rate.values()) / len(rate)
        var = sum((r - mean) ** 2 for r in rate.values()) / len(rate)
        inv = sum(1 / len(fs) for fs in hosts.values()) / len(hosts)
        between = max(var - mean * (1 - mean) * inv, 1e-9) / max(1 - inv, 1e-9)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)
        bad |= {h for h, fs in hosts.items() if (sum(f[rule] for f in fs) + mean * strength) / (len(fs) + strength) > limit}
    return [not f[0] and not f[1] and s not in bad for f, (_, _, s) in zip(fails, rows)]


def _grams(text):
    data = [32 if b < 33 else b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    return [((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 18 for a, b, c in zip(data, data[1:], data[2:])]


def languages(pages, labelled, worth=60.0, strength=8.0):
    """page_id: (lang, prob) of pages (page_id, url, html), with all labelled (text, lang) in the model."""
    counts = defaultdict(Counter)
    for text, lang in labelled:
        counts[lang].update(_grams(text))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * (1 << 14) for x in langs}
    n, rows = len(langs), []
    for page, url, html in pages:
        html = html or ""
        host = (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")) and m[1].lower() or ""
        part = lambda p: (m := re.search(p, host)) and m[1] or ""  # noqa: B023, E731
        said = (m := re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", html)) and m[1].lower() or ""
        text = re.sub(r"&#?\w+;", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html))
        grams = _grams(text)
        score = [sum(math.log((counts[x][g] + 0.5) / total[x]) for g in grams) / max(len(grams), 1) * min(max(len(grams), 1), worth) for x in langs]
        post = [math.exp(s - max(score)) for s in score]
        rows.append((page, host, part(r"([^.]+\.[^.]+)$"), part(r"([^.]+)$"), said, [p / sum(post) for p in post]))

    def sums(key):
        out = defaultdict(lambda: [0.0] * n)
        for r in rows:
            out[key(r)] = [a + b for a, b in zip(out[key(r)], r[5])]
        return out
    shrunk = lambda s, prior: [(max(x, 0.0) + strength * p) / (sum(s) + strength) for x, p in zip(s, prior)]
    whole = sums(lambda r: 0)[0]
    world = [(x + 1) / (sum(whole) + n) for x in whole]
    hosts, domains, suffixes, declared = sums(lambda r: r[1]), sums(lambda r: r[2:4]), sums(lambda r: r[3]), sums(lambda r: r[4])
    out = {}
    for page, host, domain, suffix, said, post in rows:
        of_suffix = shrunk(suffixes[suffix], world)
        prior = shrunk([a - b for a, b in zip(hosts[host], post)], shrunk(domains[domain, suffix], of_suffix))
        score = [sum(math.log(max(x, 1e-9)) for x in (p, q, s / w, (d + 0.5) / (t + 1))) for p, q, s, w, d, t in zip(post, prior, of_suffix, world, declared[said], whole)]
        top = max(score)
        out[page] = langs[score.index(top)], 1 / sum(math.exp(s - top) for s in score)
    return out


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def randomness(core, alphabet):
    """p value of the battery of tests, as Fisher's sum of three."""
    n, k = len(core), len(alphabet)
    chi = k / n * sum(c * c for c in Counter(core).values()) - n
    ps = [tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    at = [alphabet.index(c) + 1 for c in core]
    bits = [2 * a > k for a in at]
    ones, runs = sum(bits), 1 + sum(a != b for a, b in zip(bits, bits[1:]))
    mean = 1 + 2 * ones * (n - ones) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    ps.append(2 * tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0)
    off = [a - sum(at) / n for a in at]
    spread = sum(x * x for x in off)
    ps.append(2 * tail(abs(sum(a * b for a, b in zip(off, off[1:])) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0)
    half = sum(-math.log(max(min(p, 1.0), 1e-12)) for p in ps)
    return math.exp(-half) * (1 + half + half * half / 2)


def random_spans(rows, token, encodings, cuts, fdr, base):
    """Of each row (doc_id, text) the random spans that touch no span of `base[doc_id]`."""
    found, classes = [], defaultdict(list)
    for doc, text in rows:
        for m in re.finditer(token, text or ""):
            core = m[0].rstrip("=")
            name = next((e for e, (pattern, _) in encodings.items() if re.fullmatch(pattern, core)), None)
            if name is None or not re.search("[0-9]", core) or not re.search("[A-Za-z]", core):
                continue
            kind = name, min(math.floor(math.log2(len(core))), 12)
            p = randomness(core, encodings[name][1])
            classes[kind].append(p)
            found.append((doc, m.start(), m.end(), kind, p))
    least = {}
    for kind, ps in classes.items():
        keys = min(len(ps), 2 * sum(p > cuts[-1] for p in ps))
        least[kind] = next((c for c in cuts if (passed := sum(p > c for p in ps)) and max(0.0, passed - keys * (1 - c)) <= fdr * passed), 1.0)
    return [(d, s, e) for d, s, e, kind, p in found if p > least[kind] and not any(a < e and s < b for a, b in base[d])]
