"""The operators as queries over the given tables: whole tables, whole texts, production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm.caps import link_vectors
from rosterloom.llm.chat import format_chats, read_chats, with_probe
from rosterloom.llm.line_rules import quality
from rosterloom.llm.mixing import taken_words
from rosterloom.llm.near_duplicates import near_duplicates
from rosterloom.llm.negatives import mined
from rosterloom.llm.pieces import segmented
from rosterloom.llm.repair import repaired_reports
from rosterloom.llm.tables import kept_as, table
from rosterloom.llm.token_counts import token_counts
from rosterloom.llm.token_file import read_token_files, write_token_files
from rosterloom.llm.toxicity import toxicity
from rosterloom.llm.urls import judge_pages
from rosterloom.llm.warc import read_records, write_warc
from rosterloom.workspace import work_folder


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = kept_as(format_chats(with_probe(table(spark, sf_dir, "conversations"))), work_folder(spark, "chats"))
    return read_chats(formatted).withColumn("valid", F.col("problem").isNull()).drop("problem")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), work_folder(spark, "token-file"))
    return read_token_files(spark, manifest)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_reports(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), work_folder(spark, "warc"))
    return read_records(spark, manifest).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_chat_formatting, op2_quality_rules, op3_token_counts, op4_toxicity, op5_embedding_near_dedup,
    op6_minhash_near_dedup, op7_url_filters, op8_token_file, op9_sentencepiece, op10_mixing,
    op11_hard_negatives, op12_conversation_repair, op13_warc)}
