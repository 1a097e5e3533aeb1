"""A training corpus in five stages: quality, near duplicates, secrets, mixture, packing.

Each stage is ``(name, function)`` with ``function(spark, docs, sf_dir) -> DataFrame``. Its rows are
written as Parquet and read again as the ``docs`` of the next stage. All but the last return the
columns of ``documents``; the last returns pieces of packed windows.

An empty ``documents`` table passes through every stage. Null and empty texts are documents like
any other: they are scored, linked to each other as copies, have no secrets, take no room in the
mixture and become a single closing id in the packing. Extra columns of ``documents`` are kept
through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import Scratch
from marginalia.llm.mixing import mixed_documents
from marginalia.llm.packing import pack
from marginalia.llm.quality import good_documents
from marginalia.llm.secrets import redacted
from marginalia.llm.simhash import one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return one_per_group(docs, radius=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; documents without one stay as they are."""
    return redacted(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them whole."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixture", source_mixture),
    ("packing", packing),
]

#: Fitted models and the tokenizer cannot be stated in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
