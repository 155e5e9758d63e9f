"""Corpus pipeline: language ID, near-duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; ``run`` writes each
stage's result as Parquet into the shared folder and reads it again for the next one; what no stage needs any more is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import common, fair_mix, langid, pii, queries, simhash, spm


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language cannot be told, go; all others stay as they are, also where no language could be learned."""
    prefix = common.unused_prefix(docs, "m_")
    found = langid.detect(docs, langid.train(docs), letters=True, prefix=prefix)
    return found.filter(f"{prefix}has_letter").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id."""
    return simhash.dedup(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text is generalised or removed; n_chars is counted anew."""
    done = pii.sanitise(docs)
    return done.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return fair_mix.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces."""
    return spm.encoding_digest(docs, queries.MODEL)


STAGES = [("language", identify_language), ("near-duplicates", near_duplicates), ("personal data", sanitise), ("mixing", mix_sources), ("encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents."""
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            common.remove(spark, f"{folder}/{i - 1}")
    return docs
