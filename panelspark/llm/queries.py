"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ego import embedding_near_duplicates
from .hamming import hamming_top_k, sign_code
from .jaccard import jaccard_components
from .line_dedup import drop_recurring_lines
from .mixing import mix_sources
from .packing import pack
from .pii import personal_data
from .quality import quality_scores
from .secret_scan import secret_spans
from .token_counts import section_tokens


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    found = hamming_top_k(codes, codes.where(F.col("id") % 50 == 0), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_personal_data": op7_personal_data,
    "op8_quality_classifier": op8_quality_classifier,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_top_k": """
        WITH codes AS (
            SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS bits
            FROM embeddings WHERE len(embedding) > 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: abs(p[1] - p[2]))) AS INTEGER) AS distance
            FROM codes q, codes c WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
        )
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
    """,
}
