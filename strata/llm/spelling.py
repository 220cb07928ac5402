"""Spelling variants: frequent words attract the rare words one edit away.

Words are maximal letter runs, counted with map-side combine. Candidates come from a rare-first q-gram prefix
filter: bigrams get one global order by frequency, and each word is posted under its three rarest bigrams, with
their positions. One edit spoils at most two bigrams of a word, so two words one edit apart share one of the
three: the words are alike from their beginning through it, or from it to their end. So postings meet by length and that part of the
word, which holds the bigram and its position, and pairs are verified by edit distance in the join itself.

The order has at most 90 x 90 bigrams (the letters of the pattern after lower-casing), so it is one small row for every
task. A bucket of more than `hot` words is not compared pair by pair: its postings carry the word less one letter of its
other part as well, and words one edit apart agree in one of these; such a sub-bucket holds at most one word for each letter.
Keys are 64-bit hashes; what collides is told apart by the verification. A word's near words are at most a few thousand, so no
later group is large.

Cases: null or empty text has no words; a null id is an empty string in the hash that picks what is deleted;
repeated rows count as often as they stand; of equal counts the form of least code points wins; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import ascii_lower, let, staged, text_or_empty

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: A word one edit away shares one of this many rarest bigrams.
PREFIX = 3


def thinned(run: Column, id_text: Column, every: int = 31) -> Column:
    """The run, or the run less one letter where `every` divides its hash."""
    h, n = F.crc32(F.concat(id_text, F.lit(":"), run).cast("binary")), F.char_length(run)
    at = (h % n).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """word, n. Shorter runs never make a word, so the pattern passes them over."""
    pattern = F.lit(f"[A-Za-zÀ-ÿ]{{{least_chars},}}")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(text_col), pattern, F.lit(0))).alias("run"))
    words = runs.select("id", ascii_lower(F.col("run")).alias("run")).select(thinned(F.col("run"), F.col("id"), every).alias("word"))
    return words.filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def bigrams(word: Column) -> Column:
    """Numbers of a word's bigrams by position, from 0."""
    codes = F.transform(F.split(word, "(?<=.)(?=.)"), lambda c: F.instr(F.lit(LETTERS), c) - 1)
    return let(codes, lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - 2), lambda i: F.get(cs, i) * len(LETTERS) + F.get(cs, i + 1)))


def gram_order(words: DataFrame) -> list[int]:
    """The place of every possible bigram in the order by frequency among `words`, ties by bigram."""
    counts = dict(words.select(F.explode(bigrams(F.col("word"))).alias("g")).groupBy("g").count().collect())  # one row a bigram
    order = sorted(range(len(LETTERS) ** 2), key=lambda g: (counts.get(g, 0), g))
    places = [0] * len(order)
    for place, g in enumerate(order):
        places[g] = place
    return places


def postings(words: DataFrame) -> DataFrame:
    """word, n, size, pos: the PREFIX rarest bigrams of each word."""
    order = words.sparkSession.createDataFrame([(gram_order(words),)], "places array<int>")
    placed = lambda places: F.transform(bigrams(F.col("word")), lambda g, i: F.struct(F.get(places, g).alias("gram"), i.alias("pos")))
    rare = words.join(F.broadcast(order)).select("word", "n", F.char_length("word").alias("size"), F.explode(F.slice(F.array_sort(placed(F.col("places"))), 1, PREFIX)).alias("p"))
    return rare.select("word", "n", "size", "p.pos")


def less_one(word: Column, begin: Column, end: Column) -> Column:
    """The word without its i-th letter, for each i from `begin` to `end`."""
    at = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))


def near_pairs(words: DataFrame, hot: int = 128) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words one edit apart."""
    word, size, pos = F.col("word"), F.col("size"), F.col("pos")
    # The edit is behind the shared bigram, and all through it is alike, or before it, and all from it on is alike.
    sides = F.array(F.struct(F.lit("<").alias("side"), F.substring(word, F.lit(1), pos + 2).alias("alike"), (pos + 3).alias("begin"), size.alias("end")),
                    F.struct(F.lit(">").alias("side"), F.substring(word, pos + 1, size).alias("alike"), F.lit(1).alias("begin"), pos.alias("end")))
    sided = staged(postings(words).select("word", "n", "size", F.explode(sides).alias("s")).select("word", "n", "size", "s.*"), "postings")
    key = lambda length: F.xxhash64(length, "side", "alike")  # noqa: E731  lengths of both sides tell the position; pairs are verified
    held, longer = sided.withColumn("key", key(size)), sided.withColumn("key", key(size - 1))
    large = staged(held.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("hot")), "hot_buckets")
    # In a hot bucket the letter that differs is left out: of words as long the same one, of a longer word any.
    rest = less_one(word, F.col("begin"), F.col("end"))
    places = F.transform(rest, lambda x, i: F.xxhash64("key", i, x))
    wholes = lambda words_: F.transform(words_, lambda x: F.xxhash64("key", x))

    def dealt(rows: DataFrame, parts: Column) -> DataFrame:
        at = F.explode(F.when(F.col("hot"), parts).otherwise(F.array("key")))
        return rows.join(large, "key", "left").select(at.alias("key"), "word", "n")

    edited = F.col("begin") <= F.col("end")
    as_long, whole, asking = dealt(held.filter(edited), places), dealt(held, wholes(F.array(word))), dealt(longer.filter(edited), wholes(F.array_distinct(rest)))
    near = lambda rows: rows.select("key", word.alias("near"), F.col("n").alias("near_n"))
    one_edit = F.levenshtein(word, F.col("near"), 1) == 1
    met = as_long.join(near(as_long), "key").filter((word < F.col("near")) & one_edit).unionByName(asking.join(near(whole), "key").filter(one_edit))
    met = staged(met.select("word", "n", "near", "near_n").distinct(), "near_pairs")
    return met.unionByName(met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(links: DataFrame) -> DataFrame:
    """word, root: links (word, form) followed to their last. Each round doubles the steps taken, and a chain is short,
    as every step raises the count by a factor."""
    now = staged(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = staged(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2, factor: int = 10, every: int = 31, hot: int = 128) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least `least_chars` letters and `least_count` occurrences."""
    words = staged(word_counts(docs, id_col, text_col, least_chars, least_count, every), "words")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words, hot).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    strong = -F.col("best.less") >= factor * F.col("n")
    near = staged(near.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(near.filter("form is not null"))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
