"""Secret spans: fixed patterns, and tokens that a battery of randomness tests takes for keys.

Only DataFrame functions run. Matches are placed by splitting the text at them, so offsets are sums of
lengths in code points. A token of 20 or more key characters that mixes digits and letters gets the
narrowest encoding that can hold it, and three tests of uniform randomness over that alphabet:
chi-squared of symbol counts, runs above and below the alphabet's middle, and serial correlation of
neighbours; Fisher's sum gives one p value. Ordinary tokens crowd near 0, keys spread evenly. For each
encoding and length class the number of keys follows from the upper half of the p values, and the class
takes the least cut at which the expected share of ordinary tokens above it stays within `fdr`. Short
classes, where tests are weak and ordinary tokens pass them, so get a higher cut or none.

Cases: null text counts as empty; repeated rows are scanned as rows and count as such in the classes; an
empty table gives no rows; other columns are ignored. Time follows the matches of a text in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import let, scanned, staged, text_or_empty

#: Fixed patterns. For access and hex the least lengths are part of the pattern, which changes no match:
#: their matches are whole runs. An assignment is matched first and dropped if its value is short.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding: (pattern of the whole token, alphabet). The first that fits is taken.
ENCODINGS = {
    "hex": ("[0-9a-f]+", DIGITS + "abcdef"),
    "HEX": ("[0-9A-F]+", DIGITS + "ABCDEF"),
    "base32": ("[A-Z2-7]+", UPPER + "234567"),
    "base36": ("[0-9a-z]+", DIGITS + LOWER),
    "BASE36": ("[0-9A-Z]+", DIGITS + UPPER),
    "base62": ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    "base64": ("[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
}
CUTS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
SPAN = "array<struct<start:int,kind:int,end:int>>"


def placed(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans (start, kind, end) of the pattern's matches whose group has `least` characters."""
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    lengths = F.zip_with(F.zip_with(pieces, whole, lambda p, w: F.struct(F.char_length(p).alias("gap"), F.char_length(w).alias("size"))), value,
                         lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (F.char_length(v) >= least).alias("good")))

    def spans(marks: Column) -> Column:
        ends = scanned(F.transform(marks, lambda m: m["gap"] + m["size"]), F.lit(0), lambda a, b: a + b)
        every = F.zip_with(marks, ends, lambda m, e: F.struct((e - m["size"]).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m["good"].alias("good")))
        return F.transform(F.filter(every, lambda x: x["good"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    found = let(F.filter(lengths, lambda m: m["size"].isNotNull()), spans)
    return F.when(F.regexp_like(text, F.lit(pattern)), found.cast(SPAN)).otherwise(F.array().cast(SPAN))


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    def positive(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return let(positive(F.least(F.abs(z), F.lit(37.0))), lambda p: F.when(z >= 0, p).otherwise(1 - p))


def randomness(core: Column, alphabet: Column) -> Column:
    """p value of the three tests together, of a token over its alphabet."""
    n, k = F.char_length(core).cast("double"), F.char_length(alphabet).cast("double")
    squares = lambda chars: F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.char_length(F.replace(core, c, F.lit(""))), F.lit(2)))

    def uniform(chars: Column) -> Column:
        return upper_tail((k / n * squares(chars) - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))

    def runs(bits: Column) -> Column:
        size = F.size(bits)
        changes = F.size(F.filter(F.zip_with(F.slice(bits, F.lit(1), size - 1), F.slice(bits, F.lit(2), size - 1), lambda a, b: a != b), lambda x: x))
        ones = F.size(F.filter(bits, lambda x: x)).cast("double")
        mean = 1 + 2 * ones * (n - ones) / n
        spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        return F.when(spread > 0, 2 * upper_tail(F.abs((1 + changes - mean) / spread))).otherwise(0.0)

    def serial(idx: Column) -> Column:
        def of(mean: Column) -> Column:
            off = F.transform(idx, lambda i: i - mean)
            both = F.zip_with(F.slice(off, F.lit(1), F.size(idx) - 1), F.slice(off, F.lit(2), F.size(idx) - 1), lambda a, b: a * b)
            total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
            spread = total(F.transform(off, lambda x: x * x))
            return F.when(spread > 0, 2 * upper_tail(F.abs((total(both) / spread + 1 / n) * F.sqrt(n)))).otherwise(0.0)
        return let(F.aggregate(idx, F.lit(0.0), lambda a, i: a + i) / n, of)

    def together(chars: Column) -> Column:
        idx = F.transform(chars, lambda c: F.position(c, alphabet).cast("double"))
        ps = let(idx, lambda i: F.array(uniform(chars), runs(F.transform(i, lambda x: x * 2 > k)), serial(i)))
        half = F.aggregate(ps, F.lit(0.0), lambda a, p: a - F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))  # chi-squared of 6 degrees

    return let(F.filter(F.split(core, ""), lambda c: c != ""), together)


def candidates(text: Column) -> Column:
    """Spans of tokens with their class and p value: array of (start, end, stratum, p)."""
    def tested(s: Column, token: Column) -> Column:
        def of(core: Column) -> Column:
            name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
            for e, (pattern, letters) in reversed(ENCODINGS.items()):
                fits = F.regexp_like(core, F.lit(f"^{pattern}$"))
                name, alphabet = F.when(fits, e).otherwise(name), F.when(fits, letters).otherwise(alphabet)
            mixed = F.regexp_like(core, F.lit("[0-9]")) & F.regexp_like(core, F.lit("[A-Za-z]"))
            length = F.least(F.floor(F.log2(F.char_length(core))), F.lit(12))
            p = F.when(mixed & name.isNotNull(), randomness(core, alphabet))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat_ws(":", name, length).alias("stratum"), p.alias("p"))
        return let(F.rtrim(token, F.lit("=")), of)

    # All matches are placed, so spans and matches go in pairs.
    found = F.filter(F.zip_with(placed(text, TOKEN, 3), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), tested), lambda c: c["p"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(TOKEN)), found).otherwise(F.array().cast("array<struct<start:int,end:int,stratum:string,p:double>>"))


def apart(spans: Column) -> Column:
    """`spans`, in order, without those of kind 3 that overlap one of another kind."""
    far = F.lit(2**31 - 1)

    def kept(xs: Column) -> Column:
        reach = scanned(F.transform(xs, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        ahead = scanned(F.transform(F.reverse(xs), lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(far)), far, lambda a, b: F.least(a, b))
        free = F.zip_with(xs, F.zip_with(reach, F.reverse(ahead), lambda r, a: F.struct(r.alias("reach"), a.alias("ahead"))),
                          lambda x, y: F.struct(x.alias("x"), ((x["kind"] < 3) | ((y["reach"] <= x["start"]) & (y["ahead"] >= x["end"]))).alias("stays")))
        return F.transform(F.filter(free, lambda f: f["stays"]), lambda f: f["x"])
    return let(spans, kept)


def cuts(rows: DataFrame, fdr: float) -> dict[str, float]:
    """The cut of each class that has one; classes are at most encodings times 13 lengths."""
    tested = rows.select(F.explode("candidates").alias("c")).select("c.*")
    above = [F.sum((F.col("p") > c).cast("long")).alias(f"above_{i}") for i, c in enumerate(CUTS)]
    out = {}
    for r in tested.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above).collect():
        keys = min(r["n"], 2 * r[f"above_{len(CUTS) - 1}"])
        for i, c in enumerate(CUTS):
            passed = r[f"above_{i}"]
            if passed and max(0.0, passed - keys * (1 - c)) <= fdr * passed:
                out[r["stratum"]] = c
                break
    return out


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.1) -> DataFrame:
    """One row per row of `docs`: doc_id, base_spans and spans, arrays of (start, kind, end) in order."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    text = F.col("text")
    fixed = F.array_sort(F.concat(placed(text, ASSIGN, 0, 2, 6), placed(text, ACCESS, 1), placed(text, HEX, 2)))
    rows = staged(base.select("doc_id", fixed.alias("base_spans"), candidates(text).alias("candidates")), "candidates")
    cut = cuts(rows, fdr)
    if cut:
        least = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
        found = F.filter("candidates", lambda c: c["p"] > least[c["stratum"]])
    else:
        found = F.filter("candidates", lambda c: F.lit(False))
    added = F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    spans = let(added, lambda more: F.when(F.size(more) == 0, F.col("base_spans")).otherwise(apart(F.array_sort(F.concat("base_spans", more)))))
    return rows.select("doc_id", "base_spans", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))
