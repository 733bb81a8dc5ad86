"""From documents to token ids: five stages, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again for the next one.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docgraph.llm import bpe, mixing, pii, simhash, toxicity
from docgraph.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the classifier, fitted on the labelled ones, rejects go."""
    model = toxicity.classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span is replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each pass in which words of a document are taken, with the taken words as its text."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: ids, their digest and the digest of the text decoded from them."""
    return bpe.encode_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each_group),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: Neither the classifier, nor the fingerprints, nor the draws can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
