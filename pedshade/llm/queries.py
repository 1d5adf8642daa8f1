"""Registered queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedshade.llm import linededup, search
from pedshade.llm.common import documents
from pedshade.llm.conversations import repair_conversations
from pedshade.llm.decontaminate import contaminated
from pedshade.llm.fingerprint import document_fingerprints
from pedshade.llm.langid import language_id
from pedshade.llm.licenses import license_scan
from pedshade.llm.linededup import line_dedup
from pedshade.llm.quality import classify
from pedshade.llm.search import ranked_search
from pedshade.llm.sharding import shard_documents
from pedshade.llm.simhash import simhash_groups
from pedshade.llm.substrings import dedup_substrings
from pedshade.llm.urlfilter import judge_urls
from pedshade.llm.wfst import encode_digests, read_model


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), read_model())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table has no URLs: source is the host, and its languages are the paths below it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir), labels, F.col("source"), F.col("lang"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_substrings": op4_substrings,
    "op5_sharding": op5_sharding,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": linededup.oracle(),
    "op11_ranked_search": search.oracle(),
}
