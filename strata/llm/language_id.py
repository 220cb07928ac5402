"""Language identification that fuses evidence by Bayes' rule.

log P(lang | page) = text likelihood + P(declared markup language | lang) + P(address suffix | lang)
+ host prior, up to a constant. The text model is multinomial over hashed byte trigrams, fitted on at most
`sample` labelled documents (those of least seeded hash of id and text, chosen before any text moves; the one
bounded sample here). Everything else is
grouped aggregation over all pages: the text posteriors, summed by declared language, suffix, registered
domain and host, give the likelihoods and a prior that shrinks host to domain to suffix to the whole
table. A page's own posterior is taken out of its host's sums, so that no text counts twice.

Cases: null or empty markup says nothing and the page follows its other evidence; a null address has an
empty host, domain and suffix; a missing declaration is a value like others; ties go to the first
language in order; repeated rows are pages of their own; an empty table gives no rows, and labels
of one language give that language; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.shared import parts, staged, trimmed, utf8

BUCKETS = 1 << 14


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket numbers of the byte trigrams that start at each place; A-Z lower-cased, white space one."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    low[(data < 33)] = 32
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(18)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        data, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            total = np.zeros(BUCKETS, np.int64)
            for i in np.flatnonzero(langs == lang):
                text = data[offsets[i] : offsets[i + 1]]
                if len(text) > 2:
                    total += np.bincount(_trigrams(text), minlength=BUCKETS)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["lang", "bucket", "n"])


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """The rows of the `sample` least values of the seeded hash `h`, and any that tie with the last.

    Hashes spread evenly, so one bound, from the number of rows, leaves few more than are asked for however many
    partitions there are; the driver then sees those hashes alone, and no text moves.
    """
    total = rows.count()
    if total <= sample:
        return rows
    share = (sample + 8 * math.sqrt(sample) + 32) / total
    while True:
        below = rows.filter(F.col("h") < int(share * 2.0**64) - 2**63) if share < 1 else rows
        hashes = [r["h"] for r in below.select("h").distinct().orderBy("h").limit(sample).collect()]
        if len(hashes) == sample or share >= 1:
            return rows.filter(F.col("h") <= hashes[-1])
        share *= 4


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (languages x BUCKETS)."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(11), id_col, text_col).alias("h")).filter("lang is not null and text is not null")
    counts = sampled(rows, sample).select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts})
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in counts:
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _scored(model, worth: float):
    """Posterior of the text alone: trigrams depend on each other, so a text is worth `worth` of them at most."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in trimmed(batches):
            data, offsets = utf8(batch.column("text"))
            post = np.zeros((batch.num_rows, len(table)))
            for i, j in parts(offsets):
                grams = _trigrams(data[offsets[i] : offsets[j]]) if offsets[j] - offsets[i] > 2 else np.zeros(0, np.int64)
                for k, row in enumerate(table):
                    total = np.concatenate([[0.0], np.cumsum(row[grams])])
                    a = np.minimum(offsets[i:j] - offsets[i], len(grams))
                    b = np.clip(offsets[i + 1 : j + 1] - offsets[i] - 2, a, len(grams))
                    n = np.maximum(b - a, 1)
                    post[i:j, k] = (total[b] - total[a]) / n * np.minimum(n, worth)
            post = np.exp(post - post.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            at = pa.array((np.arange(batch.num_rows + 1) * len(table)).astype(np.int32))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.ListArray.from_arrays(at, pa.array(post.ravel()))], [*names, "post"])
    return rows


def visible(html: Column) -> Column:
    """Text of markup: scripts, styles, comments and tags out, entities as space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?\w+;", " ")


def _sums(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    return rows.groupBy(*key).agg(F.array(*[F.sum(F.get("post", F.lit(i))) for i in range(n)]).alias("sums"))


def _shrunk(sums: Column, prior: Column, strength: float) -> Column:
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(sums, prior, lambda s, p: (F.greatest(s, F.lit(0.0)) + strength * p) / (total + strength))


def language_id(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                sample: int = 2000, worth: float = 60.0, strength: float = 8.0) -> DataFrame:
    """One row per row of `pages`: page_id, host, suffix, declared, text_lang, lang, prob."""
    langs, table = fit(labelled, sample=sample)
    n = len(langs)
    if not n:
        return pages.select(F.col(id_col).alias("page_id"), *[F.lit(None).cast("string").alias(c) for c in ("host", "suffix", "declared", "text_lang", "lang")], F.lit(None).cast("double").alias("prob"))
    model = pages.sparkSession.sparkContext.broadcast(table)
    html = F.coalesce(F.col(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    base = pages.select(
        F.col(id_col).alias("page_id"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"), visible(html).alias("text"))
    fields = [*[base.schema[c] for c in ("page_id", "host", "domain", "suffix", "declared")], T.StructField("post", T.ArrayType(T.DoubleType()))]
    rows = staged(base.mapInArrow(_scored(model, worth), T.StructType(fields)), "text_posteriors")
    # host sums first, so that the coarser levels aggregate rows of hosts, not of pages.
    hosts = staged(_sums(rows, ["host", "domain", "suffix"], n).withColumnRenamed("sums", "post"), "host_sums")
    whole = [float(x or 0) for x in _sums(hosts, [], n).first()["sums"]]
    world = F.array(*[F.lit((x + 1) / (sum(whole) + n)) for x in whole])
    suffixes = _sums(hosts, ["suffix"], n).select("suffix", _shrunk(F.col("sums"), world, strength).alias("suffix_prior"))
    domains = _sums(hosts, ["domain", "suffix"], n).join(suffixes, "suffix").select("domain", "suffix", "suffix_prior", _shrunk(F.col("sums"), F.col("suffix_prior"), strength).alias("domain_prior"))
    # Hosts without two parts have the domain '' under several suffixes.
    priors = staged(hosts.select("host", "domain", "suffix", F.col("post").alias("host_sums")).join(domains, ["domain", "suffix"]).drop("domain", "suffix"), "host_priors")
    said = _sums(rows, ["declared"], n).select("declared", F.col("sums").alias("said_sums"))
    said = staged(said.select("declared", F.zip_with("said_sums", F.array(*[F.lit(x) for x in whole]), lambda s, t: (s + 0.5) / (t + 1.0)).alias("said")), "declared")
    met = rows.join(priors, "host").join(said, "declared")
    prior = _shrunk(F.zip_with("host_sums", "post", lambda s, p: s - p), F.col("domain_prior"), strength)
    # P(suffix | lang) is up to a constant P(lang | suffix) / P(lang).
    suffix = F.zip_with("suffix_prior", world, lambda s, w: s / w)
    terms = [F.transform(x, lambda p: F.log(F.greatest(p, F.lit(1e-9)))) for x in (F.col("post"), prior, suffix, F.col("said"))]
    score = terms[0]
    for t in terms[1:]:
        score = F.zip_with(score, t, lambda a, b: a + b)
    scored = met.withColumn("score", score).withColumn("top", F.array_max("score"))
    total = F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda xs: F.element_at(names, F.array_position(xs, F.array_max(xs)).cast("int"))
    return scored.select("page_id", "host", "suffix", "declared", pick(F.col("post")).alias("text_lang"), pick(F.col("score")).alias("lang"), (1 / total).alias("prob"))
