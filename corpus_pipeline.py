"""A training corpus from ``documents``: five stages, each a text operator.

Toxic and low-quality documents go, one document of each group of near copies
stays, secrets are blanked, and what is left is packed into sequences.  Every
stage but the last returns the columns of ``documents``; each is written to the
shared folder as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varsight.llm import common, ngram_join, packing, quality, secrets, toxicity
from varsight.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def keep_first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_first_of_copies),
    ("secret_scans", blank_secrets),
    ("best_fit_packing", pack),
]

#: No SQL: the stages train models and cut tokens. tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the whole ``documents`` table."""
    ship_package(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
