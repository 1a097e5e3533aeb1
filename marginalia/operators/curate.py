"""Choosing rows: normalisation, quarantine, duplicates, caps, splits and leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import hashing
from marginalia.functions.arrays import with_columns_once
from marginalia.functions.text import fold_case, n_words, squeeze, strip
from marginalia.operators.ranking import attach, take_smallest, written
from marginalia.operators.tally import tally
from marginalia.schemas import MULTIWORD_POS, POS_EXCLUDED, POS_MAP, literal_map


def _pos_key(value: Column) -> Column:
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def pos_of(value: Column) -> Column:
    return F.try_element_at(literal_map(POS_MAP), _pos_key(value))


def target_norm_of(value: Column) -> Column:
    return squeeze(fold_case(strip(value)))


def multiword_of(target: Column, pos: Column) -> Column:
    return F.coalesce(pos.isin(MULTIWORD_POS), F.lit(False)) | F.contains(
        strip(target), F.lit(" ")
    )


def placeholder_of(target: Column) -> Column:
    return F.rlike(target, F.lit(r"(?i)(?<![\p{L}\p{N}_])(?:sb|sth)(?![\p{L}\p{N}_])"))


def normalize_pos(df: DataFrame, col: str) -> DataFrame:
    """Add the canonical ``pos_norm`` and whether the raw value was mapped or excluded."""
    key = _pos_key(F.col(col))
    return df.withColumn("pos_norm", pos_of(F.col(col))).withColumn(
        "pos_status",
        F.when(key.isin(POS_EXCLUDED), "excluded_pos")
        .when(F.col("pos_norm").isNull(), "unmappable_pos")
        .otherwise("ok"),
    )


def normalize_target(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("target_norm", target_norm_of(F.col(col)))


def flag_multiword(df: DataFrame) -> DataFrame:
    return df.withColumn("is_multiword", multiword_of(F.col("target"), F.col("pos")))


def flag_placeholder(df: DataFrame) -> DataFrame:
    return df.withColumn("is_placeholder", placeholder_of(F.col("target")))


def content_uid(df: DataFrame, cols: list[str], sep: str, n: int = 16) -> DataFrame:
    return df.withColumn("uid", hashing.short_uid([F.col(c) for c in cols], sep, n))


def sense_quarantine(
    df: DataFrame, min_definition_chars: int = 3, source_digest: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split joined sense rows into the pool and the quarantine.

    A row is refused for the first reason that holds; of rows with the same content id the
    one with the smallest ``source_sense_id`` (unique in the source) stays. The checked rows are
    written once; an aggregate of ids finds what stays, and both outputs are filters on the
    marked rows.
    """
    if min_definition_chars < 1:
        raise ValueError("a definition needs a least length of one or more")
    raw_pos = F.coalesce(F.col("pos"), F.lit(""))
    clean = with_columns_once(
        df.select(
            "source_sense_id",
            F.col("definition").alias("_d"),
            F.col("headword").alias("_h"),
            raw_pos.alias("raw_pos"),
            F.when(F.col("cefr_level") != "", F.col("cefr_level")).alias("cefr"),
        ),
        definition=strip(F.coalesce("_d", F.lit(""))),
        target=strip(F.coalesce("_h", F.lit(""))),
        pos=pos_of(F.col("raw_pos")),
    )
    tidy = clean.drop("_d", "_h").withColumn(
        "reason",
        F.when(F.col("definition") == "", "empty_definition")
        .when(F.length("definition") < min_definition_chars, "definition_too_short")
        .when(F.col("target") == "", "empty_target")
        .when(_pos_key(F.col("raw_pos")).isin(POS_EXCLUDED), "excluded_pos")
        .when(F.col("pos").isNull(), "unmappable_pos"),
    )
    tidy = tidy.withColumn("target_norm", target_norm_of(F.col("target"))).withColumn(
        "sense_uid",
        hashing.short_uid([F.col("target_norm"), F.col("pos"), F.col("definition")], "|"),
    )
    tidy = written(tidy)
    usable = F.col("reason").isNull()
    # Only ids meet here: the smallest source id of each content id, with its number of rows.
    first = (
        tidy.where(usable)
        .groupBy(F.col("sense_uid"))
        .agg(F.min("source_sense_id").alias("_first"), F.count("*").alias("_n"))
    )
    marked = attach(tidy, first, ["sense_uid"], "_n").withColumn(
        "reason",
        F.when(usable & (F.col("source_sense_id") > F.col("_first")), "duplicate_uid").otherwise(F.col("reason")),
    )
    pool = marked.where(F.col("reason").isNull()).select(
        "sense_uid",
        "source_sense_id",
        "target",
        "target_norm",
        "pos",
        "definition",
        "cefr",
        multiword_of(F.col("target"), F.col("pos")).alias("is_multiword"),
        placeholder_of(F.col("target")).alias("is_placeholder"),
        F.lit(source_digest).cast("string").alias("source_db_sha256"),
    )
    quarantine = marked.where(F.col("reason").isNotNull()).select("source_sense_id", "reason", "raw_pos")
    as_text = F.col("source_sense_id").cast("string")
    return (
        pool.withColumn("source_sense_id", as_text),
        quarantine.withColumn("source_sense_id", as_text),
    )


def pool_quality(pool: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Counts over the pool and the quarantine as rows ``(section, key, n)``."""
    counted = tally(
        pool,
        pool_rows=F.lit("all"),
        pos=F.col("pos"),
        cefr=F.coalesce(F.col("cefr"), F.lit("null")),
        multiword_rows=F.when(F.col("is_multiword"), "all"),
        placeholder_rows=F.when(F.col("is_placeholder"), "all"),
    )
    groups = pool.agg(F.count_distinct("target_norm").alias("n")).select(
        F.lit("target_groups").alias("section"), F.lit("all").alias("key"), "n"
    )
    return counted.unionByName(groups).unionByName(tally(quarantine, quarantine=F.col("reason")))


def edit_bucket(df: DataFrame, col: str = "n_edits") -> DataFrame:
    n = F.col(col)
    return df.withColumn(
        "edit_bucket",
        F.when(n == 0, "clean").when(n == 1, "one").when(n <= 3, "few").otherwise("many"),
    )


def drop_fragments(df: DataFrame, min_words: int = 3) -> DataFrame:
    return df.where(F.col("n_words") >= min_words)


def derive_row_stats(df: DataFrame) -> DataFrame:
    """Add ``n_words``, ``n_edits`` and the sorted distinct ``tags`` of an ``edits`` array."""
    edits = F.coalesce(F.col("edits"), F.array().cast(df.schema["edits"].dataType))
    return (
        df.withColumn("n_words", n_words(F.col("text")))
        .withColumn("n_edits", F.size(edits))
        .withColumn(
            "tags", F.array_sort(F.array_distinct(F.transform(edits, lambda e: e["tag"])))
        )
    )


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an explicit order column; ties fall by a hash of the row."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("r"))
    return first.select(key, "r.*").select(*df.columns)


def later_copies(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows ``dedupe_first`` drops; ``order`` must be unique."""
    kept = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(kept.select(order), order, "left_anti")


def cap_strata(
    df: DataFrame,
    strata: list[str],
    max_stratum_share: float,
    seed: int,
    uid: str = "row_uid",
    **limits: int,
) -> DataFrame:
    """Keep at most ``int(n * share)`` rows per stratum, chosen by seeded digest.

    The cap comes from the row count before capping; strata below it are kept whole.
    """
    if not 0 < max_stratum_share <= 1:
        raise ValueError("the share of a stratum lies above 0 and up to 1")
    keyed = df.withColumn("_order", hashing.seeded(seed, F.col(uid).cast("string")))

    def cap(rows: int) -> int:
        return max(1, int(rows * max_stratum_share))

    return take_smallest(keyed, strata, "_order", cap, **limits).drop("_order")


def group_split(
    df: DataFrame,
    group: str | list[str],
    seed: int,
    train: float = 0.8,
    val: float = 0.1,
    version: str | None = None,
) -> DataFrame:
    """Assign whole groups to train, val or test by digest; a missing group is an error."""
    if not (0 < train < 1 and 0 < val < 1 and train + val < 1):
        raise ValueError("shares have to leave something to each of the three splits")
    names = [group] if isinstance(group, str) else group
    keys = [F.when(F.col(c) != "", F.col(c)) for c in names]
    key = F.coalesce(*keys, F.raise_error(F.lit("every row needs a group for a grouped split")))
    point = hashing.bucket(seed, key) / F.lit(float(hashing.BUCKETS))
    out = df.withColumn("_point", point).withColumn(
        "split",
        F.when(F.col("_point") < train, "train")
        .when(F.col("_point") < train + val, "val")
        .otherwise("test"),
    )
    out = out.drop("_point").withColumn("seed", F.lit(seed).cast("long"))
    return out if version is None else out.withColumn("split_version", F.lit(version))


def row_split(df: DataFrame, uid: str, seed: int, val_share: float = 0.05) -> DataFrame:
    if not 0 < val_share < 1:
        raise ValueError("the validation share lies between 0 and 1")
    point = hashing.bucket(seed, F.col(uid)) / F.lit(float(hashing.BUCKETS))
    return df.withColumn("split", F.when(point < val_share, "val").otherwise("train"))


def _by_text(df: DataFrame) -> DataFrame:
    split = F.col("split")
    return df.groupBy(hashing.digest(F.col("text")).alias("text_hash")).agg(
        F.min("split").alias("lowest"),
        F.max("split").alias("highest"),
        *[F.count_if(split == s).alias(s) for s in ("train", "val", "test")],
    )


def contamination(df: DataFrame) -> DataFrame:
    """How many texts occur in more than one split, and the rows per split."""
    crossing = F.col("text_hash").isNotNull() & (F.col("lowest") != F.col("highest"))
    return _by_text(df).agg(
        F.count_if(crossing).alias("cross_split_text_hashes"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("train", "val", "test")],
    )


def text_overlap(df: DataFrame) -> DataFrame:
    """The texts that occur in more than one split, with their rows per split."""
    return (
        _by_text(df)
        .where(F.col("text_hash").isNotNull() & (F.col("lowest") != F.col("highest")))
        .drop("lowest", "highest")
    )


def strict_test(df: DataFrame, **limits: int) -> DataFrame:
    """Test rows whose exact text is in no train or validation row."""
    keyed = df.withColumn("_text", hashing.digest(F.coalesce("text", F.lit(""))))
    per_text = (
        keyed.groupBy("_text")
        .agg(
            F.max(F.col("split").isin("train", "val")).alias("_seen"),
            F.count_if(F.col("split") == "test").alias("_n"),
        )
        .where(F.col("_n") > 0)
    )
    tests = keyed.where(F.col("split") == "test")
    marked = attach(tests, per_text, ["_text"], "_n", **limits)
    return marked.where(~F.col("_seen")).select(*df.columns)


def seeded_sample(df: DataFrame, n: int, seed: int, uid: str = "req_uid") -> DataFrame:
    """``n`` rows in seeded-digest order; each task keeps only its own first ``n``."""
    order = hashing.seeded(seed, F.col(uid).cast("string"))
    return df.withColumn("_o", order).orderBy("_o").limit(n).drop("_o")


def ordered_output(df: DataFrame, keys: list[str]) -> DataFrame:
    """Globally ordered by range: partition i holds only keys before partition i+1."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
