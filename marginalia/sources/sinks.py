"""Writing the dataset with fixed schemas and order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import hashing
from marginalia.functions.text import n_words
from marginalia.operators.curate import strict_test

ROWS_PER_GROUP = 50_000


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in its order and types; a missing one is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def sink_fixed_schema(
    df: DataFrame, schema: T.StructType, path: str, sort_by: str | list[str], codec: str = "zstd"
) -> None:
    """Write parquet with a pinned schema, globally ordered by id."""
    keys = [sort_by] if isinstance(sort_by, str) else sort_by
    ordered = as_schema(df, schema).repartitionByRange(*keys).sortWithinPartitions(*keys)
    (
        ordered.write.mode("overwrite")
        .option("compression", codec)
        .option("parquet.block.row.count.limit", ROWS_PER_GROUP)
        .parquet(path)
    )


def split_nonempty_gate(df: DataFrame, splits: list[str]) -> DataFrame:
    """Rows per wanted split; an empty one is an error."""
    counts = df.groupBy("split").agg(F.count("*").alias("n")).where(F.col("split").isin(splits))
    found = {r["split"] for r in counts.collect()}
    empty = [s for s in splits if s not in found]
    if empty:
        raise ValueError(f"no rows in split {empty}")
    return counts


def training_order(df: DataFrame, seed: int, uid: str = "req_uid") -> DataFrame:
    """Rows of each split in seeded-digest order, as ranges over the cluster."""
    keyed = df.withColumn("_o", hashing.seeded(seed, F.col(uid).cast("string")))
    return keyed.repartitionByRange("split", "_o").sortWithinPartitions("split", "_o").drop("_o")


def gated_write(df: DataFrame, path: str, facts: dict[str, Column], gate: Callable[[dict], None], keep: Column | None = None) -> dict:
    """Write ``df`` to ``path`` if ``gate`` lets what was observed on the way pass.

    ``df`` is evaluated once: ``facts`` are aggregates that ride on the write, over all rows, also over
    those that ``keep`` leaves out of it. Nothing is to be seen at ``path`` before the gate has passed, and
    nothing of it is left if it refuses.
    """
    spark = df.sparkSession
    staged, seen = f"{path}.staged-{uuid.uuid4().hex}", Observation()
    rows = df.observe(seen, *[c.alias(n) for n, c in facts.items()])
    (rows if keep is None else rows.where(keep)).write.parquet(staged)
    found = {k: v or 0 for k, v in seen.get.items()}
    here, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        gate(found)
    except ValueError:
        files.delete(here, True)
        raise
    files.delete(there, True)
    files.rename(here, there)
    return found


def sink_splits(
    df: DataFrame, rejects: DataFrame, path: str, seed: int, uid: str = "req_uid", splits: list[str] | None = None
) -> None:
    """Write the splits (shuffled for training), the rejects and the strict test rows.

    ``df`` is evaluated once; an empty one of the wanted ``splits`` is an error, and then nothing is
    written. The order and the strict rows are made from what was written.
    """
    wanted = splits or []

    def gate(found: dict) -> None:
        empty = [s for i, s in enumerate(wanted) if not found[f"n{i}"]]
        if empty:
            raise ValueError(f"no rows in split {empty}")

    facts = {"rows": F.count(F.lit(1))} | {f"n{i}": F.count_if(F.col("split") == s) for i, s in enumerate(wanted)}
    gated_write(df, f"{path}/rows", facts, gate)
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    training_order(rows, seed, uid).write.mode("overwrite").partitionBy("split").parquet(
        f"{path}/processed"
    )
    rejects.write.mode("overwrite").parquet(f"{path}/rejects")
    strict_test(rows).write.mode("overwrite").parquet(f"{path}/test_strict")
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sink_report(metrics: DataFrame, path: str) -> None:
    """Write a small metrics table as ordered JSON lines; no clock, so reruns are equal."""
    cols = sorted(metrics.columns)
    ordered = metrics.select(*cols).orderBy(*cols).coalesce(1)
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def training_pairs(df: DataFrame) -> DataFrame:
    """Prompt inputs and the reference completion as JSON with sorted keys and kept nulls."""
    answer = F.struct("correction", "feedback", "meaning")
    return df.select(
        "req_uid", "target", "definition", "pos", "text",
        F.to_json(answer, {"ignoreNullFields": "false"}).alias("completion"),
    )


def length_filter(
    df: DataFrame, max_tokens: int, max_drop_fraction: float = 0.02, col: str = "text"
) -> DataFrame:
    """Rows within a blank-separated token budget; dropping too many is an error."""
    fits = n_words(F.col(col)) <= max_tokens
    n, long = df.agg(F.count("*"), F.count_if(~fits)).first()
    if n and long == n:
        raise ValueError(f"every one of {n} rows exceeds {max_tokens} tokens")
    if n and long / n > max_drop_fraction:
        raise ValueError(f"{long} of {n} rows exceed {max_tokens} tokens")
    return df.where(fits)


def write_within_length(
    df: DataFrame, path: str, max_tokens: int, max_drop_fraction: float = 0.02, col: str = "text"
) -> dict:
    """Write the rows that ``length_filter`` keeps, under its bar, in one evaluation of ``df``."""
    fits = F.coalesce(n_words(F.col(col)) <= max_tokens, F.lit(False))

    def gate(found: dict) -> None:
        n, long = found["rows"], found["long"]
        if n and long == n:
            raise ValueError(f"every one of {n} rows exceeds {max_tokens} tokens")
        if n and long / n > max_drop_fraction:
            raise ValueError(f"{long} of {n} rows exceed {max_tokens} tokens")

    return gated_write(df, path, {"rows": F.count(F.lit(1)), "long": F.count_if(~fits)}, gate, fits)
