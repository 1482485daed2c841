"""From ``documents`` to packed token sequences, in five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, whatever further columns the table has. Each works on all rows that the one before it kept. Inner
columns take names that the table doesn't have. Without rows, each stage gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import dedup, mixing, packing, quality, secrets
from gramloom.llm._common import Store, table, unused

ORACLE_SQL = None  # signatures, a fitted model and token ids can't be expressed in SQL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted to ``labels``, rejects.

    A null text counts as an empty one; repeated rows go or stay together; without labels all rows stay.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of near duplicates.

    Null, empty and blank texts and rows without id stay; of rows with equal id and text one stays.
    """
    return dedup.drop_near_duplicates(docs, Store(spark, "near"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the text. Null texts stay null, and every row stays."""
    base, spans = unused(docs, "base_spans", "spans")
    clean = secrets.redact(secrets.find_secrets(docs, names=(base, spans)), spans=spans)
    return _counted(clean, F.size(spans) > 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves of each document what the mix takes of its words, repeats one below another; n_chars follows the text.

    Rows come in shards, shuffled within each. Rows without words, and those of which the mix takes none, go; a null
    source is a source of its own; rows with equal ids are rows of their own.
    """
    return _counted(mixing.mixed_documents(docs, Store(spark, "mix")), F.lit(True)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into token sequences; a row for each piece. A null text is the end token alone."""
    return packing.pack(docs, Store(spark, "packing"))


def _counted(docs: DataFrame, changed) -> DataFrame:
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return docs
