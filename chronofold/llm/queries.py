"""The corpus operators as registered queries, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.llm import decontaminate, html_extract, language_id, license_scan, mixing, pii, simhash, substring_dedup, token_codec, topk
from chronofold.llm.common import table


def op10_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q, len(embedding) AS dim
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum([a.q[i] * b.q[i] FOR i IN range(1, a.dim + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.dim = b.dim)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

def op1_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_token_output(spark, sf_dir, tokenizer: str = "word_bpe_49k.json"):
    import public_tokenizers

    return token_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), end_id=1)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN low USING (k) WHERE doc_id > lo),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT e.doc_id, count(g.j) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.j) FILTER (g.j IS NULL), '') AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op5_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_distance=4)


def op7_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_html_extraction": op2_html_extraction, "op3_token_output": op3_token_output, "op4_substring_dedup": op4_substring_dedup, "op5_language_id": op5_language_id, "op6_simhash": op6_simhash, "op7_pii": op7_pii, "op8_license_scan": op8_license_scan, "op9_mixing": op9_mixing, "op10_exact_top_k": op10_exact_top_k}
ORACLES = {"op4_substring_dedup": OP4_SQL, "op9_mixing": mixing.report_sql(), "op10_exact_top_k": OP10_SQL}
