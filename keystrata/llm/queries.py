"""The corpus queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_topk, language_id, line_dedup, lm_scoring, minhash, packing, quality, substring_dedup, token_counts

#: The packages' vocabularies have the end of text under this id in the packing contract.
END_ID = 2


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *(columns or ("text",)))
    cores = spark.sparkContext.defaultParallelism
    # a table of fewer splits than cores (one small file) is dealt out, or one task would do all the work
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_documents(spark, sf_dir), min_words=50, keep_text=False)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = byte_bpe.encode_documents(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), END_ID, 1024)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir), keep_text=False)
    return out.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.col("lines_sha256").alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = lm_scoring.score_documents(_documents(spark, sf_dir), "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), 1024)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), 5, 75).select("doc_id", "n_shingles", "component_id", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "text", "lang")
    held_out = language_id.fold("doc_id", 4) == 2
    out = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_substring_dedup, op2_byte_bpe, op3_best_fit_packing, op4_line_dedup, op5_lm_scoring, op6_token_counts,
        op7_minhash, op8_language_id, op9_quality_rules, op10_exact_topk, pipeline,
    )
    return {f.__name__: f for f in own}


_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM win JOIN low USING (h) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word LEFT JOIN gone USING (doc_id, p) WHERE gone.doc_id IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT a, v FROM reach JOIN edge ON b = u),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM root LEFT JOIN n USING (doc_id)"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
f AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]+', '', 'g')) AS bangs,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_words < 5 * bangs OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR n_dup_lines * 2 > len(lines)
    OR len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) * 2 < n_words OR len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) * 3 > n_words OR (n_words >= 50 AND len(list_distinct(w)) * 20 < n_words)) AS kept
FROM b"""

_OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM r)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op7_minhash": _OP7, "op9_quality_rules": _OP9, "op10_exact_topk": _OP10}
