"""From raw documents to token ids in five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook.llm import mixing, near_duplicates, personal_data, piece_codec, quality_rules
from strandbook.llm.common import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, labels)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more; the smallest doc_id stays."""
    return near_duplicates.keep_one(docs, width=5, num=80, den=100)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the new text."""
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    return mixing.mixed(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the token ids of each text."""
    return piece_codec.encode(docs.select("doc_id", "source", "text")).drop("text")


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed_to_weights),
    ("SentencePiece encoding and decoding", as_pieces),
]

#: Learned rules, similarity groups and token ids have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = scratch.keep(docs, f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs
