"""The queries of this subpackage, one per operator, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.decontaminate import contamination, hit_counts
from blocklens.llm.fingerprint import neighbour_likeness
from blocklens.llm.line_dedup import without_repeated_lines
from blocklens.llm.mixing import copies_to_take, mix_sql
from blocklens.llm.ngram_join import ngram_components
from blocklens.llm.pii import personal_data
from blocklens.llm.quality import quality
from blocklens.llm.token_counts import token_counts
from blocklens.llm.toxicity import toxicity
from blocklens.llm.wavelet import encode_and_read_back

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold() != 1)
    return scored.select(F.col("id").alias("doc_id"), (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "toxic")


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read_back(table(spark, sf_dir, "documents"), vocabulary())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_counts(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_likeness(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_to_take(table(spark, sf_dir, "documents")).drop("inclusion", "th", "row")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold() != 1)
    return scored.select(F.col("id").alias("doc_id"), (fold() == 1).alias("held_out"), "score", "content_score", "page_score", "keep")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_toxicity, op3_wavelet_tokens, op4_decontamination, op5_token_counts, op6_line_dedup, op7_fingerprint, op8_pii, op9_mixing, op10_quality)}


def ngram_sql(k: int = 3, num: int = 9, den: int = 10) -> str:
    """The shingle join over ``documents`` in DuckDB's SQL."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= {k} THEN list_distinct(list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams
  FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND {den} * a.n >= {num} * b.n AND {den} * b.n >= {num} * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING {den + num} * count(*) >= {num} * (a.n + b.n)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM s UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
alike AS (SELECT doc_id, CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(grams)) END AS class_id FROM s)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, class_id, component_id
FROM s JOIN least ON s.doc_id = least.v JOIN alike USING (doc_id)
"""


def decontamination_sql(window: int = 10) -> str:
    """Window hits over ``documents`` and ``benchmark`` in DuckDB's SQL."""
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS words FROM benchmark),
iw AS (SELECT item, least({window}, len(words)) AS k, words, unnest(range(1, len(words) - least({window}, len(words)) + 2)) AS pos FROM i WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(words[pos:pos + k - 1], ' ') AS win FROM iw),
sizes AS (SELECT DISTINCT k FROM windows),
d AS (SELECT doc_id, {words} AS words FROM documents),
dw AS (SELECT doc_id, k, words, unnest(range(1, len(words) - k + 2)) AS pos FROM d, sizes WHERE len(words) >= k),
hits AS (SELECT doc_id, pos, dw.k AS k, item FROM dw JOIN windows w ON dw.k = w.k AND array_to_string(dw.words[pos:pos + dw.k - 1], ' ') = w.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": ngram_sql(), "op4_decontamination": decontamination_sql(), "op9_mixing": mix_sql()}
