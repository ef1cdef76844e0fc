"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.near_dups import drop_near_duplicates
from logloom.llm.packing import pack_documents
from logloom.llm.quality_rules import filter_quality
from logloom.llm.shared import staged, table
from logloom.llm.source_mixing import mixed_documents
from logloom.llm.substring_dedup import remove_repeats

#: Words of a shingle in the near-dup stage; op8's contract of two binds its query alone.
SHINGLE = 5


def measured(docs: DataFrame) -> DataFrame:
    """n_chars as it is after a stage that changes texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: filter_quality(docs)),
    ("minhash_near_dups", lambda spark, docs, sf_dir: drop_near_duplicates(docs, width=SHINGLE)),
    ("suffix_array_dedup", lambda spark, docs, sf_dir: measured(remove_repeats(docs))),
    ("source_mixing", lambda spark, docs, sf_dir: measured(mixed_documents(docs))),
    ("best_fit_packing", lambda spark, docs, sf_dir: pack_documents(docs)),
]
#: Tokenizing and best-fit packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
