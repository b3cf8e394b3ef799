"""Five stages over ``documents``: quality, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellquarry.llm.common import forget, written
from cellquarry.llm.linededup import dedup_lines
from cellquarry.llm.mixture import mix_sources
from cellquarry.llm.pieces import encode_pieces
from cellquarry.llm.quality import keep_good
from cellquarry.llm.queries import MIX_WEIGHTS, source_domain
from cellquarry.llm.simhash import one_of_each

#: No SQL: the stages fit models and sample.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, each document once at most, nearer to the target weights."""
    return mix_sources(docs, source_domain(), MIX_WEIGHTS, share=0.9, most_epochs=1, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, beside its own columns."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("source mixture", mixture), ("SentencePiece sampling", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        forget(before)  # the stage has read it; the documents themselves are no written table
    return STAGES[-1][1](spark, docs, sf_dir)
