"""A corpus pipeline of five stages; each works on all rows that the stage before it kept.

Null texts are empty: the quality rules reject them. Repeated rows are copies of which exact dedup keeps one; null ids, null
sources and further columns stay as they are, whatever their names. Empty tables stay empty. The result of a stage is to be
written before the next one is called, which then deletes the tables that the stage before needed on its way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm.common import materialize, step
from trackloom.llm.exact_dedup import drop_copies
from trackloom.llm.jaccard_join import drop_near_copies
from trackloom.llm.line_rules import clean_documents
from trackloom.llm.mixing import mixed_documents
from trackloom.llm.packing import pack
from trackloom.llm.queries import tokenizer_path

#: SQL can express neither the tokens nor the schedule; the tests hold run() against a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their source share; null and short texts go."""
    with step(docs, 0):
        return clean_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id, null ids last."""
    with step(docs, 1):
        return drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: the one with the smallest id; texts without words stay."""
    with step(docs, 2):
        return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document once per epoch in which it is taken; a null source is one of its own."""
    with step(docs, 3):
        return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens; doc_row tells repeated documents apart, also those with equal or null ids."""
    with step(docs, 4):
        return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
