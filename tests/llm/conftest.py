import random

import pytest

#: Rows that every operator on documents must take: nulls, empties, ties, repeats, one long text.
ODD = [(900, None, None, None), (901, "", "en", "s1"), (902, " \n\t\n", "en", None), (903, "one two", "de", "s2"),
       (904, "One  two", "de", "s2"), (905, "word " * 3000, "en", "s1"), (906, "word " * 3000, "en", "s1"), (907, "é ß Σ İ x", "fr", "s3"),
       (908, "dup line that is long enough\n" * 5, "en", "s1"), (909, "DUP line that is long enough \nother", "en", "s1"), (910, "  dup line that is long enough\n\n", "en", "s3")]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, _k int, rep long, spans string"


@pytest.fixture
def corpus():
    """Documents with copies, near copies, shared passages and odd rows: [(doc_id, text, lang, source)]."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["été", "Straße", "Ñu"]
    base = [[r.choice(words) for _ in range(r.randint(20, 120))] for _ in range(12)]
    passage = [r.choice(words) for _ in range(40)]
    rows = []
    for i in range(120):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.3:
            text = text[:10] + passage + text[10:]
        for k in range(9, len(text), 10):
            text[k] += "\n"
        rows.append((i, " ".join(text), "en", f"s{min(r.randrange(9), 4)}"))
    return rows + ODD + [rows[3], rows[3]]


@pytest.fixture
def frame(spark):
    """A documents table of such rows, with other columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)
    return make
