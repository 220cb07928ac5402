"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import chat_format, exact_dedup, fill_middle, language_id, line_dedup, mixing, ngram_join, quality_rules, secret_scan, sentence_pieces, spelling, suffix_dedup, suffix_tree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(more)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "quota")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(_table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(_table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str, model_path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return sentence_pieces.encode_and_check(_table(spark, sf_dir, "documents"), model_path)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents")).drop("xx")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_middle(_table(spark, sf_dir, "documents")))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_source_mixing, op4_line_dedup, op5_exact_dedup, op6_secret_scan, op7_language_id, op8_sentence_pieces, op9_ngram_jaccard_join, op10_suffix_dedup,
                              op11_fill_middle, op12_suffix_tree, op13_spelling_variants)
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.holder AS lost
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op1_chat_format": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         regexp_replace(regexp_replace(regexp_replace(replace(text, '\\', '\\\\'), '<(\\||/?s>|/?<SYS>>|</SYS>>)', '<\\\\\\1', 'g'), '<(</?SYS>>)', '<\\\\\\1', 'g'), '\\[(/?INST\\])', '[\\\\\\1', 'g') AS esc
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(esc) + CASE WHEN before = role THEN length('<|im_next|>') ELSE length(role) + length('<|im_start|><|im_sep|><|im_end|>') END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op2_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + 4)) AS n FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM win, range(0, 5) g(k) WHERE n > 1 GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(CASE rule WHEN 1 THEN n_words < 10 WHEN 2 THEN 100 * n_repeat_words > 20 * n_words WHEN 3 THEN 10 * n_symbols > n_words WHEN 4 THEN 10 * n_dup_lines > n_words
  ELSE word_chars < 2 * n_words OR word_chars > 15 * n_words END::INT) AS f FROM m, range(1, 6) g(rule) GROUP BY ALL),
s AS (SELECT rule, avg(1 / n) AS inv, avg(f / n) AS mean, var_pop(f / n) AS var FROM h GROUP BY rule),
k AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / (greatest(var - mean * (1 - mean) * inv, 1e-9) / greatest(1 - inv, 1e-9)) - 1, 1.0), 1e4) AS strength FROM s),
v AS (SELECT source, NOT bool_or((f + mean * strength) / (n + strength) > 0.5) AS host_ok FROM h JOIN k USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, host_ok,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND host_ok AS kept FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met.n >= 80 * (x.size + y.size - met.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(size, 0) AS n_shingles, c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)""",
    "op10_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
h AS (SELECT r, i, md5(b[i:i + 399]) AS m FROM (SELECT r, b, unnest(range(1, n - 398)) AS i FROM d) x),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS c FROM h) y WHERE c > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM dup),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
s AS (SELECT r, min(i) AS a, max(i) + 399 AS z FROM k GROUP BY r, run),
p AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
t AS (SELECT r, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS last, string_agg(CASE WHEN a - 1 > before THEN hex(b[before + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS x FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256,
  decode(unhex(regexp_replace(k, '([0-7][0-9A-F]|[CD][0-9A-F][89AB][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F]){2}|F[0-7](?:[89AB][0-9A-F]){3})|..', '\1', 'g'))) AS kept_text
FROM (SELECT doc_id, n, n_removed, n_spans, CASE WHEN x IS NULL THEN hex(b) ELSE x || CASE WHEN last < n THEN hex(b[last + 1:n]) ELSE '' END END AS k FROM d LEFT JOIN t USING (r)) z""",
    "op11_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
x AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
    "op13_spelling_variants": r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS r FROM documents) z),
kinds AS (SELECT doc_id, run, count(*) AS times, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY ALL),
hashes AS (SELECT run, times, length(run) AS len, xor(list_reduce(list_transform(range(length(x) // 2), lambda k: ('0x' || x[2 * k + 1:2 * k + 2])::BIGINT),
  lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h FROM kinds, crc),
thin AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % len] || run[h % len + 2:] ELSE run END AS word, times FROM hashes),
w AS (SELECT word, sum(times)::BIGINT AS n FROM thin WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w) z),
met AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.rest = w.word UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.rest = w.word),
best AS (SELECT a AS word, count(*) AS n_near, min((-w.n, encode(b))) AS best FROM met JOIN w ON w.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * w.n THEN decode(best[2]) END AS form, CASE WHEN -best[1] >= 10 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN forms f ON f.word = walk.next)
SELECT forms.word, forms.form, walk.at AS root, n, n_near, form_n FROM forms JOIN walk ON walk.word = forms.word AND walk.next IS NULL""",
}
