"""The queries that apply each corpus operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.llm import (
    license_scan,
    main_text,
    packed_products,
    packing,
    piece_codec,
    presence_search,
    quality,
    quality_rules,
    simhash,
    substring_dedup,
    transport_stream,
    vector_graph,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), revisit_from=0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_codec.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_round_trip(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return packed_products.hard_negatives(vectors.withColumn("label", moved), every=100, k=5, share=80)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_warc": op5_warc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_media_columns": op9_media_columns,
    "op10_license_scans": op10_license_scans,
    "op11_quality_rules": op11_quality_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
}

_TEMPLATE_ROWS = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(license_scan.TEMPLATES))

LICENSES_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}') AS low FROM documents
), words AS (
  SELECT r, doc_id, low, list_filter(regexp_split_to_array(low, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM docs
), placed AS (
  SELECT *, list_filter(range(1, len(w) + 1), lambda i: (w[i] = 'mit' AND w[i + 1] = 'license') OR (w[i] = 'apache' AND w[i + 1] = 'license')
    OR (w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license')) AS spots FROM words
), labelled AS (
  SELECT *, list_filter(['apache', 'gpl', 'mit'], lambda l: list_bool_or(list_transform(spots, lambda i: w[i] = CASE l WHEN 'gpl' THEN 'general' ELSE l END))) AS base FROM placed
), templates AS (
  SELECT n, label, len(string_split(t, ' ')) AS width, list_distinct(string_split(t, ' ')) AS t FROM (VALUES {_TEMPLATE_ROWS}) AS v(n, label, t)
), may AS (
  SELECT r, label, width, t, w FROM words, templates WHERE len(list_intersect(w, t)) / len(t) >= {license_scan.THRESHOLD}
), windows AS (
  SELECT r, label, t, width, w, unnest(range(1, len(w) + 1)) AS i FROM may
), hits AS (
  SELECT r, label, len(list_intersect(w[i : i + width - 1], t)) / len(t) AS share FROM windows
), best AS (
  SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM hits WHERE share >= {license_scan.THRESHOLD} GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) - 1 AS BIGINT) AS first_word,
  CAST(list_max(spots) - 1 AS BIGINT) AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  greatest(CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE 0.0 END, coalesce(share, 0.0)) AS score
FROM labelled LEFT JOIN best USING (r)
"""

_STOP_LIST = ", ".join(f"'{w}'" for w in quality_rules.written_forms(quality_rules.STOP_WORDS))
_SHARES = {
    "n_words": "n_words",
    "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
    "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END",
    "bare_word_share": "CASE WHEN n_words > 0 THEN (n_words - n_lettered) / n_words ELSE 0 END",
    "stop_word_share": "CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END",
    "dup_line_share": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
    "words_per_line": "CASE WHEN n_lines > 0 THEN n_words / n_lines ELSE 0 END",
}


def _broken(rule: quality_rules.Rule) -> str:
    tests = [f"{_SHARES[rule.measure]} {sign} {bound}" for sign, bound in (("<", rule.least), (">", rule.most)) if bound is not None]
    return f"CASE WHEN {' OR '.join(tests)} THEN '{rule.measure}' END"


RULES_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    list_filter(regexp_split_to_array(regexp_replace(t, '[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS lettered
  FROM docs
), windows AS (
  SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: x IN ({_STOP_LIST}))) AS n_stop, len(lettered) AS n_lettered
  FROM parts LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    array_to_string(list_filter([{", ".join(map(_broken, quality_rules.RULES))}], lambda x: x IS NOT NULL), ',') AS broken_rules FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, broken_rules FROM judged
"""

NEGATIVES_SQL = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM used AS a, used AS c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SEARCH_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), figures AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, figures GROUP BY term, n_docs
), norms AS (
  SELECT r, doc_id, 100 - 90 + ((90 * len(w) * n_docs) // n_terms) AS m FROM docs, figures
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM counts JOIN weights USING (term) JOIN asked USING (term) JOIN norms USING (r) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

ORACLES: dict[str, str] = {
    "op10_license_scans": LICENSES_SQL,
    "op11_quality_rules": RULES_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_ranked_search": SEARCH_SQL,
}
