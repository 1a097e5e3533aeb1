"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import merkle, oracle, secrets
from marginalia.llm.langid import predict_languages
from marginalia.llm.mixing import mix
from marginalia.llm.nearest import top_inner
from marginalia.llm.packing import pack
from marginalia.llm.pii import joined_spans, personal_spans
from marginalia.llm.quality import quality_scores
from marginalia.llm.ranked import ranked_documents
from marginalia.llm.registry import query
from marginalia.llm.simhash import simhash_components
from marginalia.llm.toxicity import toxicity_scores
from marginalia.llm.url_rules import CONFIDENCE, LISTED, SUPPORT, judged_urls
from marginalia.llm.vector_links import vector_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_vector_links(spark: SparkSession, d: str) -> DataFrame:
    return vector_groups(_table(spark, d, "embeddings"), threshold=0.9)


@query(oracle.MIXING)
def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mix(_table(spark, d, "documents")).drop("shuffled")


@query()
def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash_components(_table(spark, d, "documents"), radius=3)


@query(oracle.secrets(secrets.PATTERNS, secrets.VALUE, secrets.ALPHABETS, secrets.LENGTHS, secrets.RATE, secrets.STEP, secrets.STEPS))
def op7_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, d, "documents"))


@query(oracle.url_rules(LISTED, SUPPORT, CONFIDENCE))
def op10_url_rules(spark: SparkSession, d: str) -> DataFrame:
    return judged_urls(_table(spark, d, "pages"), _table(spark, d, "labels"))


@query()
def op9_top_inner(spark: SparkSession, d: str) -> DataFrame:
    return top_inner(_table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query()
def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(_table(spark, d, "documents"))


@query()
def op1_language(spark: SparkSession, d: str) -> DataFrame:
    return predict_languages(_table(spark, d, "documents"))


@query()
def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_scores(_table(spark, d, "documents"), _table(spark, d, "labels"))


@query()
def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity_scores(_table(spark, d, "documents"), _table(spark, d, "labels"))


@query(oracle.RANKED)
def op11_ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranked_documents(_table(spark, d, "documents"), _table(spark, d, "benchmark"), k=10)


@query()
def op12_personal(spark: SparkSession, d: str) -> DataFrame:
    return personal_spans(_table(spark, d, "documents")).withColumn("spans", joined_spans("spans"))


@query(oracle.MANIFEST)
def op13_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Where the crc of the id is even, the text is claimed without its line feeds."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claimed = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle.digest_columns(merkle.manifest(_table(spark, d, "documents"), claimed))
