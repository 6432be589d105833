"""From documents to packed sequences, a stage at a time.

Each stage takes the documents that its predecessor kept; between stages they are written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenlens.llm import line_dedup, mixing, near_dup, packing, quality
from scenlens.llm.queries import BYTE_VOCABULARY, table
from scenlens.llm.shared import stored

#: Target shares of expected tokens: what stays of the corpus is its good part.
WEIGHTS = {"good": 1.0, "low": 0.0, "toxic": 0.0}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond their group's cut-offs go."""
    return quality.drop_poor(docs)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; n_chars follows the text, and a document left without a word goes too."""
    kept = line_dedup.drop_common_lines(docs, min_docs=10).select(*docs.columns)
    worded = kept.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return worded.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id."""
    return near_dup.drop_near_duplicates(docs)


def mixed_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rate is a half or more stay; rates leave the good domain's tokens whole and take the others' out.

    The classifier learns from the labelled documents of the whole table, not only from those still here.
    """
    labelled = mixing.quality_domains(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, WEIGHTS, drawn=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_VOCABULARY), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", common_lines),
    ("near duplicates", near_duplicates),
    ("mixing", mixed_domains),
    ("packing", packed),
]

#: Fitted rates and a branch-and-bound search have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
