"""One query for each operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import ann, attention_lm, ball_tree, html_text, language_id, mixing, sentencepiece_codec, sharding, simhash, substring_dedup
from concord.llm.common import table, training_part


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("group")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = training_part("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_output=False)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"), training_part("doc_id", 5) != 1, tokenizer_path())


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_ann": op4_ann,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_html_text": op7_html_text,
    "op8_mixing": op8_mixing,
    "op9_top_k": op9_top_k,
    "op10_substring_dedup": op10_substring_dedup,
}
# Scores are integers and ties go to the smaller id, so brute force has one result.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""

# Windows as text, compared by MD5.
SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p, len(words) AS n FROM d),
h AS (
  SELECT doc_id, p, n, word, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM w),
f AS (SELECT h, min(doc_id) AS first FROM h WHERE p + 50 <= n GROUP BY h),
m AS (SELECT h.doc_id, p, word, coalesce(p + 50 <= n AND first < h.doc_id, false) AS again FROM h LEFT JOIN f ON h.h = f.h),
c AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

ORACLES: dict[str, str] = {"op9_top_k": TOP_K_SQL, "op10_substring_dedup": SUBSTRING_SQL}
