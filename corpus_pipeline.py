"""The corpus pipeline: quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept, written as Parquet in the shared folder and read again.  The table
``labels`` of sf_dir is the holdout of the quality rules.

All stages but the last keep the columns of docs, whatever their names.  An empty
table gives an empty one.  Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import line_dedup, packing, quality, simhash
from millrace.llm.common import load, new_path
from millrace.llm.queries import BYTE_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs.  Null, empty and
    short texts fail the base rules and go; repeated rows are judged alike."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; those of which nothing is left
    go.  Null and empty texts stay.  The order is (doc_id, hash of the text), null ids
    first; rows that agree in both come out alike."""
    return line_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.
    Repeated rows leave one; texts without a word are copies of each other; rows
    without a doc_id stay."""
    return simhash.keep_one_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the kept documents' pieces in sequences of 2048 tokens.  Null texts
    are packed as empty ones, null ids and repeated rows like any other."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_copies),
    ("near_dedup", near_copies),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, anchors and token ids have no SQL form; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
