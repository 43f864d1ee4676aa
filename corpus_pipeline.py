"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. Null, empty and very long texts, repeated
rows and empty tables go through every stage: texts without letters leave with
the first, the others are treated as the stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import best_fit_lp, jaccard_join, lang_id, mixing, surrogates
from spanloom.session import cut_lineage, tune


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of their best language accepts."""
    tune(spark)
    return lang_id.drop_foreign(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    tune(spark)
    return jaccard_join.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates; n_chars follows the text."""
    tune(spark)
    out = surrogates.keep_private(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for, in order of training position."""
    tune(spark)
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    tune(spark)
    return best_fit_lp.pack(docs)


STAGES = [
    ("language", known_language),
    ("near copies", near_copies),
    ("private data", private_data),
    ("mixture", mixture),
    ("packing", packed),
]

#: Learned models, surrogates and token ids have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
