"""Edits as sets and as numbered line edits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.functions.arrays import at, each, with_columns_once
from marginalia.functions.text import units
from marginalia.schemas import TAGS, literal_rows


def lex_units(df: DataFrame, text: str) -> DataFrame:
    """One row per word or punctuation unit: 1-based index, token and offsets."""
    return (
        df.select("*", F.posexplode(units(F.col(text))).alias("_i", "_u"))
        .withColumn("unit_index", F.col("_i") + 1)
        .select(
            *[c for c in df.columns if c != text],
            "unit_index",
            F.col("_u.token").alias("token"),
            F.col("_u.start").alias("start_char"),
            F.col("_u.end").alias("end_char"),
        )
    )


def numbered_text(df: DataFrame, text: str) -> DataFrame:
    """Add the text as numbered unit lines."""
    numbered = each(units(F.col(text)), lambda u, i: F.concat_ws(" ", i + 1, u["token"]))
    return df.withColumn("numbered", F.array_join(numbered, "\n"))


@functools.cache
def _closer_lines() -> Column:
    """It has thousands of nodes, and building it takes longer than reading a long text; so it is kept."""
    return S.lines_by_expression(F.col("text"), F.col("correction"))


def edits_to_spans(df: DataFrame) -> DataFrame:
    """Add ``span_lines`` for ``text`` and ``correction``."""
    return df.withColumn("span_lines", S.lines_of_edits(F.col("text"), F.col("correction"), _closer_lines()))


def spans_to_edits(df: DataFrame) -> DataFrame:
    """Add the markup of ``span_lines`` over ``text``."""
    return df.withColumn("correction", S.markup_of_lines(F.col("text"), F.col("span_lines")))


def validate_spans(df: DataFrame) -> DataFrame:
    """Add ``span_fault``: bounds, tags and overlaps of ``span_lines`` over ``text``."""
    read = with_columns_once(df, _r=S.read_lines(F.col("span_lines")))
    fault = S.fault_of_spans(F.col("_r"), F.size(units(F.col("text"))))
    return read.withColumn("span_fault", fault).drop("_r")


def overlap_check(df: DataFrame, edits: str = "edits") -> DataFrame:
    """Add ``overlapping``: an edit starts before the previous one ends."""
    ordered = F.array_sort(
        F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))
    )

    def early(e: Column, i: Column) -> Column:
        return (i > 0) & (e["start"] < at(F.col("_o"), i - 1)["end"])

    out = with_columns_once(df, _o=ordered)
    out = out.withColumn("overlapping", F.exists(each(F.col("_o"), early), lambda x: x))
    return out.drop("_o")


def _both_sides(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    def side(df: DataFrame, p: int) -> DataFrame:
        return df.select(*keys, F.lit(p).alias("in_pred"), F.lit(1 - p).alias("in_gold"))

    stacked = side(pred, 1).unionByName(side(gold, 0))
    return stacked.groupBy(*keys).agg(
        (F.max("in_pred") == 1).alias("in_pred"), (F.max("in_gold") == 1).alias("in_gold")
    )


def match_edits(
    pred: DataFrame, gold: DataFrame, with_tag: bool = True, key: str = "req_uid"
) -> DataFrame:
    """Every distinct edit span of either side and which sides have it.

    Both tables are stacked and grouped by the edit itself, so no row's edits are paired.
    """
    return _both_sides(pred, gold, [key, "start", "end", *(["tag"] if with_tag else [])])


def edit_set_ops(pred: DataFrame, gold: DataFrame, key: str = "req_uid") -> DataFrame:
    """Per row: sizes of both edit sets, of their intersection, and whether they are equal."""
    both = F.col("in_pred") & F.col("in_gold")
    return (
        match_edits(pred, gold, True, key)
        .groupBy(key)
        .agg(
            F.count_if("in_pred").alias("n_pred"),
            F.count_if("in_gold").alias("n_gold"),
            F.count_if(both).alias("n_both"),
            (F.count_if(~both) == 0).alias("equal_sets"),
        )
    )


def tag_closure(edits: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags outside the taxonomy, and taxonomy tags without a weight, with their counts.

    ``tags`` is the weight table ``(tag, weight)``.
    """
    used = edits.groupBy("tag").agg(F.count("*").alias("n"))
    legal = literal_rows(edits.sparkSession, "tag string", [(t,) for t in TAGS])
    unknown = used.join(legal, "tag", "left_anti").select(
        "tag", F.lit("unknown_tag").alias("problem"), "n"
    )
    weighted = tags.where(F.col("weight").isNotNull()).select("tag")
    unweighted = legal.join(weighted, "tag", "left_anti").select(
        "tag", F.lit("no_weight").alias("problem"), F.lit(0).cast("long").alias("n")
    )
    return unknown.unionByName(unweighted)
