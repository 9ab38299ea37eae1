"""A training-data pipeline over documents: five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that go on. All but the
last return the columns of documents. The last returns the packing: a row for each piece of each document.

Every stage decides row by row, by row numbers of its own where it needs some, so null and repeated ids go through.
Nulls in other columns, further columns and columns whose names a stage uses itself go through unchanged. An empty
table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablestate.llm.common import keep, table
from tablestate.llm.decontaminate import clean
from tablestate.llm.kneser_ney import keep_fluent
from tablestate.llm.packing import packed_documents
from tablestate.llm.quality_rules import keep_good
from tablestate.llm.simhash import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is within their language's threshold. Null and empty texts: by the text's end alone."""
    return keep_fluent(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the likelihood ratio. Null and empty texts have no words, so they go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id, of equal ones the first row; null ids last."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs. Null and empty texts stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of all rows; null and empty texts are the end id alone."""
    return packed_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Trained models, fingerprints and packing are beyond SQL. The tests hold each stage and run() against the operators'
#: own verdicts, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
