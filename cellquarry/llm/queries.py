"""The queries of this subpackage, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative weights of the mixture's nodes; 1 where none is given.
MIX_WEIGHTS = {("domain0",): 2.0, ("domain3",): 0.5, ("domain0", "en"): 2.0, ("domain1", "es"): 1.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def source_domain() -> Column:
    """The made-up domain of a source: its number modulo 4."""
    return F.concat(F.lit("domain"), (F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 4).cast("string"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.mixture import mix_sources

    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, source_domain(), MIX_WEIGHTS, share=1.0, most_epochs=2, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), details=True).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.langid import predict_language

    return predict_language(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.bpecount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellquarry.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_inverted_multi_index": op1_inverted_multi_index,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_threshold_top_k": op3_threshold_top_k,
        "op4_sentencepiece_sampling": op4_sentencepiece_sampling,
        "op6_line_dedup": op6_line_dedup,
        "op7_source_mixture": op7_source_mixture,
        "op5_quality_classifier": op5_quality_classifier,
        "op8_language_id": op8_language_id,
        "op9_token_counts": op9_token_counts,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
    }


#: op3 by brute force.
TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    from cellquarry.llm.linededup import SQL

    return {"op3_threshold_top_k": TOP_K_SQL.strip(), "op6_line_dedup": SQL.format(docs="documents").strip()}
