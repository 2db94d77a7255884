"""From raw documents to packed training sequences, in five stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``. ``run`` writes what a stage returns as Parquet in the
shared scratch folder and reads it back as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm import language, quality_crf
from vertexloom.llm.common import exact, stored, table
from vertexloom.llm.packing import pack_documents
from vertexloom.llm.passages import cut_passages
from vertexloom.llm.shingle_join import one_of_each_group

LANGUAGE_SCORE = 0.5  # documents below are rejected
QUALITY_SCORE = 0.5  # documents below are rejected


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; learned from the languages given for documents of this input."""
    model = language.train(exact(docs, "doc_id", "text", "lang").filter(~language.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    return language.in_known_language(docs, model, LANGUAGE_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; learned from the labels of documents of this input."""
    labels = exact(table(spark, sf_dir, "labels"), "doc_id", "quality").filter(~language.held_out("doc_id", 4, 2))
    return quality_crf.of_quality(docs, quality_crf.train(docs, labels), QUALITY_SCORE)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat from others; the first one in a fixed order keeps its copy."""
    return cut_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", packing),
]

#: SQL can't express the trained stages; tests hold a run against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
