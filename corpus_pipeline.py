"""The training-data pipeline: documents through five of the operators, stage by stage.

A stage gets what its predecessor kept, written and read again, so a lost executor costs at most
one stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterloom.llm.line_rules import clean
from rosterloom.llm.mixing import mix
from rosterloom.llm.near_duplicates import without_near_duplicates
from rosterloom.llm.pieces import segmented
from rosterloom.llm.tables import kept_as, table
from rosterloom.llm.toxicity import without_toxic
from rosterloom.workspace import work_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, unchanged."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough of their text, without the lines that break a rule."""
    return clean(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; copies are rows of their own."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces and lossless: the sampled pieces of every row."""
    return segmented(docs)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("minhash near-dedup", minhash_near_dedup),
          ("mixing", mixing), ("sentencepiece", sentencepiece)]

# The classifier, the near-duplicates and the sampled pieces cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept_as(stage(spark, docs, sf_dir), work_folder(spark, "pipeline"))
    return STAGES[-1][1](spark, docs, sf_dir)
