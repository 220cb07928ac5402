"""Operators that need a model: SentencePiece pieces, language identification, and the pipeline."""

import hashlib
import os
import random
from collections import Counter

import pytest

from strata.llm import language_id, sentence_pieces
from tests.llm import restated

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer file")


@needs_model
def test_pieces_equal_the_model(frame, corpus):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(3)
    texts = ["".join(r.choice("ab cdet hion\n.é日_-/19  ") for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += ["  Hello  wörld\n\tx  a\0b", "        def f(x):\n        return    x", "x" + " " * 37, " ", "😀x😀", "aaaaaaaa " * 9]
    rows = corpus + [(6000 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.ids for r in sentence_pieces.encode(frame(rows), MODEL).collect()}
    for doc, text, *_ in rows:
        assert got[doc] == model.encode(text or ""), text
    assert sentence_pieces.encode(frame(rows).limit(0), MODEL).count() == 0


@needs_model
def test_pieces_round_trip(frame, corpus):
    rows = corpus + [(6000, "a▁b ▁ \0\r\n", "en", "s"), (6001, "　" * 50, "en", "s")]
    found = sentence_pieces.encode_and_check(frame(rows), MODEL)
    want = sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((r.doc_id, r.decoded_sha256) for r in found.collect()) == want


WORDS = {"en": "the of and to in is that with for was this have from not", "de": "der die und das nicht mit sich auf eine für ist des auch werden", "fr": "le la les des et en une que pour dans qui est pas sur"}


def page_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        rows.append((i, lang, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(8, 60)))))
    return rows


def test_language_of_held_out_pages(spark):
    labelled = spark.createDataFrame([(i, t, lang) for i, lang, t in page_rows(300, 1)], "doc_id long, text string, lang string")
    pages = [(i, f"https://{lang}.site{i % 5}.example.com/x", f"<html lang='{lang}'><style>p{{}}</style><p>{t}</p>") for i, lang, t in page_rows(200, 2)]
    truth = {i: lang for i, lang, _ in page_rows(200, 2)}
    odd = [(900, None, None), (901, "https://de.site1.example.com/", ""), (902, "not an address", "<p>" + WORDS["fr"] + "</p>"), (903, "https://en.site2.example.com/y", "<html lang='fr'><p>" + WORDS["en"] + "</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages + odd], "page_id long, url string, html string, post int")
    got = {r.page_id: r for r in language_id.language_id(df, labelled).collect()}
    assert sum(got[i].lang == lang for i, lang in truth.items()) >= 196
    assert got[901].lang == "de"  # nothing but its host speaks
    assert got[902].lang == "fr" and got[903].lang == "en" and got[903].declared == "fr"
    assert got[900].lang in WORDS and got[900].host == ""
    assert language_id.language_id(df.limit(0), labelled).count() == 0
    assert {r.lang for r in language_id.language_id(df, labelled.limit(0)).collect()} == {None}


def test_language_equals_its_restatement(spark):
    """Fused scores of all pages: ties, nulls, repeated rows, odd addresses."""
    labelled = [(i, t, lang) for i, lang, t in page_rows(120, 3)]
    pages = [(i, f"https://{'x' if i % 4 else lang}.site{i % 6}.{('com', 'de', 'fr')[i % 3]}/x", f"<html lang='{lang if i % 5 else 'en'}'><p>{t}</p>") for i, lang, t in page_rows(90, 4)]
    pages += [(900, None, None), (901, "https://localhost/", ""), (902, "no address", "<p>" + WORDS["fr"] + "</p>"), (903, "http://[::1]/", "&amp;"), pages[3], pages[3]]
    pages = [(1000 + k, *p[1:]) for k, p in enumerate(pages)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, post string")
    got = {r.page_id: (r.lang, r.prob) for r in language_id.language_id(df, spark.createDataFrame(labelled, "doc_id long, text string, lang string")).collect()}
    want = restated.languages(pages, [(t, lang) for _, t, lang in labelled])
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_hosts_without_a_domain_give_one_row_a_page(spark):
    labelled = spark.createDataFrame([(i, t, lang) for i, lang, t in page_rows(90, 1)], "doc_id long, text string, lang string")
    urls = [None, "http://localhost/a", "http://localhost:8080/b", "http://[::1]/x", "http://intranet/", "https://a.example.com./", "/relative", "https://www.example.com/"]
    pages = [(i, urls[i % len(urls)], f"<p>{t}</p>") for i, _, t in page_rows(64, 2)]
    got = language_id.language_id(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled).collect()
    assert sorted(r.page_id for r in got) == list(range(64))
    assert {r.host: r.suffix for r in got if r.host in ("", "localhost", "intranet")} == {"": "", "localhost": "localhost", "intranet": "intranet"}


def restated_pipeline(rows):
    """Rows of the pipeline over (doc_id, text, source), by plain Python."""
    import sentencepiece
    from tests.llm.test_operators import brute_components, measures, shingles
    rows = [r for r, ok in zip(rows, restated.good(rows, measures)) if ok]
    last = {}
    for r in rows:
        last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
    rows = list({(t or "", d): (d, t, s) for d, t, s in rows if last[t or ""] == d}.values())
    rows.sort()
    rows = [r for r, c in zip(rows, brute_components(rows, [shingles(t) for _, t, _ in rows])) if r[0] == c]
    model, out = sentencepiece.SentencePieceProcessor(model_file=MODEL), Counter()
    for (doc, text, _), times in restated.copies(rows).items():
        ids = tuple(model.encode(text or ""))
        if times:
            out[doc, len(ids), ids, hashlib.sha256((text or "").encode()).hexdigest()] += times
    return out


@needs_model
def test_pipeline_stages(spark, frame, corpus, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        held.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        assert held.columns == docs.columns
        kept.append([r.doc_id for r in held.collect()])
    good, exact, near, mixed = kept
    assert set(near) <= set(exact) <= set(good) and set(mixed) <= set(near) and len(near) == len(set(near)) < len(exact) < len(good)
    assert max(mixed.count(d) for d in mixed) <= 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in out) == restated_pipeline([(d, t, s) for d, t, _, s in corpus])
