"""A pipeline for training text: five stages over the documents table.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs.  All but the last keep the columns of
documents.  SQL cannot express the language, fingerprint and piece stages, so
``ORACLE_SQL`` is None; tests compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedshade.llm.common import documents
from pedshade.llm.decontaminate import keep_uncontaminated
from pedshade.llm.langid import keep_identified
from pedshade.llm.linededup import drop_boilerplate
from pedshade.llm.simhash import keep_one
from pedshade.llm.wfst import encode, read_model
from pedshade.runtime import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and those without a letter go.

    Rows are judged one by one: a null doc_id or lang stays, repeated rows come
    out repeated, an empty table gives an empty one.
    """
    return keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less its source's boilerplate lines; n_chars follows the text.

    Null texts stay null, a null source is a source of its own, repeated rows
    count as pages each and come out repeated, an empty table gives an empty one.
    """
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set whose fingerprints link: the one with the smallest doc_id, then the smallest text hash.

    A null doc_id stays only where its set has no other; of repeated rows one
    stays; null and empty texts share fingerprint zero and link like any other;
    an empty table gives an empty one.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null texts and texts under 8 words stay; rows that share a doc_id, or have
    none, are judged each by its own text; either table may be empty.
    """
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_pieces, piece_ids, round_trip)`` of every document, the last whether its pieces decode to its text.

    A null text has no pieces, null ids and a null round trip; repeated rows
    come out repeated; an empty table gives an empty one.
    """
    return encode(docs, read_model(), [F.col("doc_id"), F.col("lang"), F.col("source")]).select(
        "row.*", F.coalesce(F.array_size("ids"), F.lit(0)).alias("n_pieces"), F.col("ids").alias("piece_ids"), "round_trip"
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("sentencepiece", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        after = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = after
    return docs
