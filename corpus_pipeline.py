"""The corpus pipeline: toxic documents go, poor ones go, one of each near-duplicate group stays, personal data is masked,
and what is left is packed into training sequences.

Every stage takes all that the one before kept, and is written and read again between them. All but the last return the
columns of documents, whatever those are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.llm.common import documents
from kerbside.llm.neardup import keep_one
from kerbside.llm.packing import pack_documents
from kerbside.llm.pii import mask_documents
from kerbside.llm.quality import keep_good
from kerbside.llm.queries import vocabulary
from kerbside.llm.toxicity import keep_clean
from kerbside.session import run_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data),
          ("packing", packing)]

#: Trained scores and tokenizers are beyond SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = run_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
