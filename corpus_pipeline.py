"""The corpus pipeline: from raw documents to packed sequences.

Five stages, each one of the operators of ``gatewright.llm``. A stage takes the session,
the documents that its predecessor kept and the folder of the input tables, and returns
a DataFrame; between stages the rows are written as Parquet to the shared folder and
read again, so a lost executor costs tasks of one stage only.

All stages but the last return the columns of their input. Null and empty texts have no
letter and go in the first stage; rows that repeat id and text are one from the second stage
on, rows that repeat an id with other texts stay apart; very long texts are whole in every
stage; empty tables pass through; extra columns stay, whatever their names, up to the last
stage, which returns the rows of packing. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewright.llm import exact_dedup, lang_id, near_dedup, packing, pii
from gatewright.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no language that the network is sure of go."""
    return lang_id.keep_known(docs, lang_id.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8), the smallest id stays."""
    return near_dedup.drop_near_copies(spark, docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the names of their kinds; every document stays."""
    return pii.redact(spark, docs, length_column="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("pii", personal_data),
    ("packing", packed),
]

#: SQL can express neither the network nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(spark, docs, name)
    return docs
