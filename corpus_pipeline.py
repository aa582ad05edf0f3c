"""Corpus pipeline: toxicity, near duplicates, secrets, mixing, packing.

Each stage works on all rows that its predecessor kept. The first four return the columns of documents; the last
returns the packed pieces. Nothing here can be expressed in SQL as a whole, so ORACLE_SQL is None and the stages are
tested against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import mixing, packing, secrets, simhash, toxicity
from winnower.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = f"score_{uuid.uuid4().hex}"  # no column of the input has that name
    return toxicity.score(docs, model, name=score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and of texts with four fifths of their five-word shingles in common."""
    return simhash.drop_similar(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind in angle brackets; n_chars follows the text."""
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says. Rates are 1 or more here: the mixture is reached by repeating what is
    scarce, so no clean document is lost."""
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), mixing.PIPELINE_TARGETS, least=1.0)
    return mixing.take(docs, mixed)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
