"""One query for each operator over its whole table, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.llm.bytepair import encode_documents
from kerbside.llm.common import documents
from kerbside.llm.conversations import damage, digests, repair
from kerbside.llm.fingerprints import fingerprint_documents
from kerbside.llm.katz import score_documents
from kerbside.llm.licences import scan_licences
from kerbside.llm.neardup import near_duplicates
from kerbside.llm.oracle import ORACLE
from kerbside.llm.packing import pack_documents
from kerbside.llm.pii import detect
from kerbside.llm.quality import quality_rules
from kerbside.llm.repair_runs import find_runs, run_digests
from kerbside.llm.sharding import shard_documents
from kerbside.llm.token_files import read_token_files, write_token_files
from kerbside.llm.toxicity import score_toxicity
from kerbside.session import run_folder


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=8)


def op9_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(documents(spark, sf_dir), planted=True))


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {query.__name__: query for query in (
    op1_licences, op2_toxicity, op3_token_files, op4_quality, op5_neardup, op6_packing, op7_fingerprints, op8_sharding, op9_bytepair, op10_pii,
    op11_runs, op12_katz, op13_conversations,
)}

__all__ = ["ORACLE", "QUERIES", "vocabulary"]
