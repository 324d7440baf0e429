"""Corpus pipeline: five operators of the ``llm`` package over ``documents``.

Each stage takes (spark, docs, sf_dir) and gets all rows that its predecessor kept; all but the
last return the columns of documents. Stages handle null columns, empty tables, repeated rows and
extra columns as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import best_fit_packing, decontamination, jaccard_join, language_id, secret_scan
from shelfwise.llm.common import held_out, materialise, table
from shelfwise.llm.queries import tokenizer_path

ORACLE_SQL = None  # language centroids, the network and token ids are beyond SQL


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject; the model learns from the labelled rows outside the
    held-out quarter."""
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return language_id.accepted(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark text."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every found secret replaced in the text; n_chars follows the text."""
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document that is left, packed into sequences."""
    return best_fit_packing.pack_documents(docs, tokenizer_path(), release=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet and read again."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = materialise(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
