"""Counting jobs: many counters in one pass with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.ranking import written
from marginalia.schemas import MAX_BAND, MIN_BAND, literal_rows


def tally(df: DataFrame, **sections: Column) -> DataFrame:
    """Rows ``(section, key, n)``: how often each section's value occurs.

    A section may be a string column (null is not counted) or an array of strings. A constant
    counts rows; a ``when`` without ``otherwise`` counts the rows it holds for.
    """

    def entry(name: str, value: Column) -> Column:
        kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
        keys = value if kind == "array" else F.array(value.cast("string"))
        keys = F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull())
        return F.transform(keys, lambda k: F.struct(F.lit(name).alias("section"), k.alias("key")))

    entries = [entry(name, value) for name, value in sections.items()]
    return (
        df.select(F.explode(F.concat(*entries)).alias("e"))
        .groupBy(F.col("e.section").alias("section"), F.col("e.key").alias("key"))
        .agg(F.count("*").alias("n"))
    )


def stratum_distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per stratum."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def reject_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Rows per reject reason and their share; accepted rows have a null reason."""
    by_reason = df.groupBy(F.coalesce(F.col(reason), F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("n")
    )
    by_reason = written(by_reason)
    total = by_reason.agg(F.sum("n")).first()[0] or 0
    return by_reason.withColumn("share", F.col("n") / F.lit(float(max(total, 1))))


def validity_rate(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(reason).isNull()).alias("valid"),
        F.coalesce(F.avg(F.col(reason).isNull().cast("double")), F.lit(0.0)).alias("validity_rate"),
    )


def band_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and share of every band, including the empty ones."""
    counts = df.groupBy(F.col(col).alias("band")).agg(F.count("*").alias("n"))
    counts = written(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    bands = literal_rows(df.sparkSession, "band int", [(b,) for b in range(MIN_BAND, MAX_BAND + 1)])
    return bands.join(counts, "band", "left").select(
        "band",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (F.coalesce("n", F.lit(0)) / F.lit(float(max(total, 1)))).alias("share"),
    )


def middle_band_share(df: DataFrame, col: str = "meaning") -> DataFrame:
    """Share of rows graded 1, 2 or 3."""
    share = F.avg(F.col(col).isin(1, 2, 3).cast("double"))
    return df.agg(F.coalesce(share, F.lit(0.0)).alias("middle_band_share"))


def other_tag_share(df: DataFrame, per: str = "row") -> DataFrame:
    """Share of the catch-all tag among distinct tags per row, or among all edits."""
    if per not in ("row", "edit"):
        raise ValueError("per must be 'row' or 'edit'")
    found = F.transform("edits", lambda e: e["tag"])
    if per == "row":
        found = F.array_distinct(found)
    return df.select(F.explode(found).alias("tag")).agg(
        F.count("*").alias("tags"),
        F.coalesce(F.avg((F.col("tag") == "other").cast("double")), F.lit(0.0)).alias(
            "other_tag_share"
        ),
    )


def tag_distribution(edits: DataFrame) -> DataFrame:
    """Edits per tag, from a table with one edit per row."""
    return edits.groupBy("tag").agg(F.count("*").alias("n"))
