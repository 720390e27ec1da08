"""From raw documents to training sequences, by five of the training-data operators.

Each stage takes (spark, docs, sf_dir), calls one operator and returns the rows it keeps; what a stage returns is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from plateflow.llm import decontaminate, language_id, packing, secret_scan, simhash_dedup
from plateflow.llm.common import shared_dir
from plateflow.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from the labelled ones that aren't held out."""
    return language_id.keep_known(docs, language_id.fit(docs.where(~language_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by fingerprints, and by a Jaccard similarity of 0.8 or more, of five-word shingles."""
    return simhash_dedup.keep_one(docs, least=0.8)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed: a row for each piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontaminate", benchmarks),
    ("secret_scan", secrets),
    ("packing", sequences),
]

#: Models, fingerprints and tokens aren't for SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; all but the last are written to the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
