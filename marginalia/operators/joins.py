"""Joins between the dataset's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.ranking import checked_small, split_join


def join_senses_entries(senses: DataFrame, entries: DataFrame) -> DataFrame:
    """Senses with the headword and part of speech of their entry.

    Few entries are broadcast; else the senses of an entry that has very many are dealt apart.
    """
    heads = entries.select(F.col("id").alias("entry_id"), "headword", "pos")
    small = checked_small(heads)
    joined = split_join(senses, heads, ["entry_id"]) if small is None else senses.join(small, "entry_id")
    return joined.select(
        F.col("id").alias("source_sense_id"), "definition", "cefr_level", "headword", "pos"
    )


def join_texts_labels(texts: DataFrame, labels: DataFrame, key: str = "req_uid") -> DataFrame:
    """Labels with their text row; where both have a column, the label's counts."""
    extra = [c for c in texts.columns if c not in labels.columns]
    return texts.select(key, *extra).join(labels, key, "inner").select(*extra, *labels.columns)


def join_texts_labels_strict(
    texts: DataFrame, labels: DataFrame, key: str = "req_uid"
) -> DataFrame:
    """The same, but a label without a text is an error."""
    orphan = labels.join(texts.select(key), key, "left_anti").select(key).first()
    if orphan is not None:
        raise ValueError(f"label {orphan[0]!r} has no text row")
    return join_texts_labels(texts, labels, key)


def join_prediction_gold(pred: DataFrame, gold: DataFrame, key: str = "req_uid") -> DataFrame:
    """Predictions and references paired by id, as structs."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))

    return packed(gold, "gold").join(packed(pred, "prediction"), key, "left")
