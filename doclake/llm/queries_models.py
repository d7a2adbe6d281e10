"""Registered queries of trained models."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm.alignment import align
from doclake.llm.bpe import digests_of
from doclake.llm.common import crc_of_id
from doclake.llm.ngrams import katz_scores
from doclake.llm.packing import pack
from doclake.llm.quality import learn, score_quality
from doclake.plans.registry import table


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    labels = table(spark, sf_dir, "labels").where(crc_of_id("doc_id") % 3 != 1)
    return learn(docs, labels, "doc_id", "text", "quality")


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, "text", quality_model(spark, sf_dir, docs), keep=["doc_id"])
    return scored.select("doc_id", (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file; its content travels with the tasks, so executors need no copy."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests_of(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_multi_50k.tiktoken")).withColumnRenamed("id", "doc_id")


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, "doc_id", "text", vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = table(spark, sf_dir, "documents"), crc_of_id("doc_id") % 7 != 2
    scores, train_tokens = katz_scores(docs, "doc_id", "text", train)
    return scores.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align(docs, "doc_id", "text", vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_katz_scores": op2_katz_scores, "op6_subword_quality": op6_subword_quality, "op8_byte_bpe": op8_byte_bpe, "op10_best_fit_packing": op10_best_fit_packing,
           "op11_tokenizer_alignment": op11_tokenizer_alignment}
