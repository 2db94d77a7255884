"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm.ann import nearest
from vertexloom.llm.common import table
from vertexloom.llm.duck_bpe import encode_digests
from vertexloom.llm.language import train_and_predict
from vertexloom.llm.near_vectors import near_vectors
from vertexloom.llm.packing import pack_documents
from vertexloom.llm.passages import repeated_passages
from vertexloom.llm.periodic_runs import periodic_runs, run_digests, with_loops
from vertexloom.llm.personal_data import personal_data, span_digests
from vertexloom.llm.quality_crf import train_and_score
from vertexloom.llm.shingle_join import linked_documents
from vertexloom.llm.spelling import spelling_variants, word_counts
from vertexloom.llm.token_counts import token_counts
from vertexloom.llm.token_files import token_file_round_trip


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op2_duck_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, 2048)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents")).drop("row")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_predict(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage and source, counted in words of the two texts."""
    return repeated_passages(table(spark, sf_dir, "documents")).drop("row")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(personal_data(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_loops(table(spark, sf_dir, "documents"))))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), slip=97))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_duck_bpe": op2_duck_bpe,
    "op3_packing": op3_packing,
    "op4_near_vectors": op4_near_vectors,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_nearest": op7_nearest,
    "op8_shingle_join": op8_shingle_join,
    "op9_language": op9_language,
    "op10_passages": op10_passages,
    "op11_personal_data": op11_personal_data,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {}
