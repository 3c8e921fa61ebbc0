"""Documents to packed training sequences: toxicity, exact and near de-duplication, decontamination, packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from lodestream.llm.common import drop_path, table, written
from lodestream.llm.queries import tokenizer_files


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more; learns from the labels outside of the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(toxicity.in_learning_fold(F.col("doc_id"), 3, 1))
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs, keep="max").select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.75 or more on 5-word shingles, the document with the smallest doc_id stays."""
    return minhash.drop_near_duplicates(docs).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold 10 consecutive words of a benchmark item, or a whole shorter item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, **tokenizer_files())


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontamination", without_benchmark), ("packing", packed)]
#: SQL can express neither the toxicity grammar nor the tokenizer and the packing; tests/llm holds run() against its stages done plainly: copies, near copies, windows and token pieces by brute force, the toxicity stage by the scores of its own operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            drop_path(spark, before)  # its successor is written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
