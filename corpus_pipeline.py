"""From raw documents to token ids: five stages, each an operator of the llm subpackage.

Rejected documents go, recurring lines go, one document of each near-duplicate
group stays, sources are mixed to their weights, and what is left is encoded.
Every stage but the last returns the columns of ``documents``; the last returns
the mixed rows' ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blobweave.llm.bpe import encode_documents
from blobweave.llm.common import staged
from blobweave.llm.jaccard import keep_one
from blobweave.llm.lines import drop_recurring
from blobweave.llm.mixing import mix
from blobweave.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_recurring(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, n=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, keep=("doc_id", "lang", "source"), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("encoding", encoding),
]

#: The forest, the token automaton and the transitive links are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
