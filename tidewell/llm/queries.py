"""The queries op1 .. op13 over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fim, html, lm, media, packing, quality, secrets, suffix, toxicity, urls
from .jaccard import jaccard_components

#: Rules of the URL query: host, path, verdict (fixed values).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"), words=4, percent=85).drop("class_id", "text_id", "group_id")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(~held_out()))
    scores = toxicity.scored(docs, model, threshold=0.7)
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), window=2048, end_id=1)


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(_table(spark, folder, "pages"), URL_RULES, default="allow")


def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return secrets.secret_report(docs, secrets.fit_random_strings(docs))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    rules = quality.fit_list(docs, _table(spark, folder, "labels"))
    judged = quality.verdicts(docs, rules)
    return judged.select("row.doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words", "base_failed", "kept")


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.repeat_report(_table(spark, folder, "documents"), length=100)


def op9_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return media.with_features(media.stored(_table(spark, folder, "documents")))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_texts(_table(spark, folder, "pages"))


def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model, words = lm.fit_language_model(docs.where(~lm.held_out()), vocabulary("byte_bpe_50k.tiktoken"))
    scores = lm.scored(docs, model, words)
    return scores.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.transformed(_table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(fim.rebuilt(), 256).alias("restored_sha256"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(_table(spark, folder, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_html_extraction": op10_html_extraction,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What SQL can say: set links with their components, URL rules, cuts of texts, and counts of terms.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reached JOIN links ON x = reached.doc_id)
SELECT r.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY 1, 2""",
    "op5_url_filters": """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM rests),
fits AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS nth FROM parts p
  LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE nth = 1""",
    "op12_fill_in_middle": r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parted AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:], ''), '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parted""",
    "op13_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
members AS (SELECT DISTINCT lang, source FROM docs),
own AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
full_counts AS (SELECT m.lang, m.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
  1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q FROM members m JOIN kept k ON k.lang = m.lang JOIN langs l ON l.lang = m.lang
  LEFT JOIN own o ON o.lang = m.lang AND o.source = m.source AND o.term = k.term LEFT JOIN totals t ON t.lang = m.lang AND t.source = m.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM full_counts a JOIN full_counts b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM members a JOIN members b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM full_counts WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
