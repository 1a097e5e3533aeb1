"""The catalogue of registered queries and their SQL twins."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.operators.ranking import ready_checkpoints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: What ``spread`` may move.
SPREAD_FILES, SPREAD_BYTES = 16, 256 << 20
#: Named subqueries that the SQL twins share; each may use the others.
SHARED: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name, with the SQL that must give the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        name = fn.__name__
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def with_shared(sql: str) -> str:
    """Prefix a statement with the shared subqueries it needs, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SHARED:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(SHARED[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS (\n{SHARED[n].strip()}\n)" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for files a query writes and reads."""
    return f"{ready_checkpoints(spark)}/files-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on a small input that came in few pieces.

    Only an input of at most ``SPREAD_FILES`` files and ``SPREAD_BYTES`` is moved: a larger one
    comes in enough pieces by itself, whatever the number of cores.
    """
    files = df.inputFiles()
    if not 0 < len(files) <= SPREAD_FILES:
        return df
    spark = df.sparkSession
    size = 0
    for name in files:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return df if size > SPREAD_BYTES else df.repartition(spark.sparkContext.defaultParallelism)
