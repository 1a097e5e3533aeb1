"""Scores of predictions against references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.alignment import rewrite_counts
from marginalia.functions.arrays import at, bind, total, with_columns_once
from marginalia.functions.batches import span_counts, unsure_pattern
from marginalia.functions.markup import corrected_text, triples
from marginalia.functions.spans import fault_of_spans, read_correction, read_lines
from marginalia.functions.text import n_words, says_null, strip, strip_ends, unit_tokens, units
from marginalia.operators.grading import check_rows
from marginalia.operators.ranking import written
from marginalia.schemas import (
    GROUPS,
    MAX_BAND,
    MIN_BAND,
    TAGS,
    USAGE_TAGS,
    WEIGHTS,
    literal_map,
    literal_rows,
)


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    bottom = p * b2 + r
    return F.when(bottom == 0, 0.0).otherwise((1 + b2) * p * r / bottom)


def precision_recall(both: Column, pred: Column, gold: Column) -> tuple[Column, Column]:
    """Two empty sides agree perfectly; one empty side scores zero."""
    empty = (pred == 0) & (gold == 0)
    p = F.when(empty, 1.0).when(pred == 0, 0.0).otherwise(both / pred)
    r = F.when(empty, 1.0).when(gold == 0, 0.0).otherwise(both / gold)
    return p, r


def in_range(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(
        F.col(a).between(MIN_BAND, MAX_BAND) & F.col(b).between(MIN_BAND, MAX_BAND)
    )


def _kappa(a: Column, b: Column) -> Column:
    """One-pass quadratic kappa: squared gaps over the gaps expected from the margins."""
    a, b, n = a.cast("double"), b.cast("double"), F.count("*")
    seen = F.sum((a - b) * (a - b))
    expected = F.sum(a * a) + F.sum(b * b) - 2.0 * F.sum(a) * F.sum(b) / n
    return (
        F.when(n == 0, 0.0)
        .when(expected == 0, F.when(seen == 0, 1.0).otherwise(0.0))
        .otherwise(1.0 - seen / expected)
    )


def quadratic_weighted_kappa(
    df: DataFrame, a: str, b: str, by: list[str] | None = None
) -> DataFrame:
    pairs = in_range(df, a, b)
    grouped = pairs.groupBy(*by) if by else pairs
    return grouped.agg(F.count("*").alias("n"), _kappa(F.col(a), F.col(b)).alias("qwk"))


def meaning_metrics(df: DataFrame, a: str = "predicted", b: str = "gold") -> DataFrame:
    gap = F.abs(F.col(a) - F.col(b))

    def mean(x: Column) -> Column:
        return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))

    return in_range(df, a, b).agg(
        _kappa(F.col(a), F.col(b)).alias("qwk"),
        mean(gap == 0).alias("exact"),
        mean(gap <= 1).alias("within_one"),
        mean(gap).alias("mae"),
    )


def per_band_metrics(df: DataFrame, a: str = "predicted", b: str = "gold") -> DataFrame:
    """Rows, exact and within-one share for each gold band; null shares where it is empty."""
    gap = F.abs(F.col(a) - F.col(b))
    seen = (
        in_range(df, a, b)
        .groupBy(F.col(b).cast("int").alias("band"))
        .agg(
            F.count("*").alias("n"),
            F.avg((gap == 0).cast("double")).alias("exact"),
            F.avg((gap <= 1).cast("double")).alias("within_one"),
        )
    )
    bands = literal_rows(df.sparkSession, "band int", [(x,) for x in range(MIN_BAND, MAX_BAND + 1)])
    return bands.join(seen, "band", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _f1(p: Column, g: Column) -> Column:
    both = F.size(F.array_intersect(p, g))
    n = F.size(p) + F.size(g)
    return F.when(n == 0, 1.0).otherwise(2.0 * both / n)


def edit_f1(pred_edits: Column, gold_edits: Column) -> Column:
    """F1 of two edit sets of one row; null edits count as none."""
    both = F.struct(triples(pred_edits).alias("p"), triples(gold_edits).alias("g"))
    return bind(both, lambda s: _f1(s["p"], s["g"]))


def edit_f1_macro(df: DataFrame) -> DataFrame:
    """Mean per-row F1 of ``pred_edits`` against ``gold_edits``."""
    score = edit_f1(F.col("pred_edits"), F.col("gold_edits"))
    return df.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("edit_f1"))


def _confusions(pred: Column, gold: Column) -> Column:
    """(gold tag, predicted tag) of each span both edit arrays have.

    Where a side tags one span twice, the smallest predicted and the largest gold tag stand. Both
    sides are sorted together, a span's predicted tags before its gold ones: the first and the last
    of a span are the two that stand, and no edit is compared with all others.
    """

    def side(edits: Column, n: int) -> Column:
        made = F.transform(
            edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit(n).alias("gold"), e["tag"].alias("tag"))
        )
        return F.coalesce(made, F.array().cast("array<struct<start:int,end:int,gold:int,tag:string>>"))

    def same(x: Column, y: Column) -> Column:
        return x["start"].eqNullSafe(y["start"]) & x["end"].eqNullSafe(y["end"])

    def standing(all_: Column) -> Column:
        first = lambda x, i: (x["gold"] == 0) & ~same(at(all_, i - 1), x)
        last = lambda x, i: (x["gold"] == 1) & ~same(at(all_, i + 1), x)
        return bind(F.filter(all_, lambda x, i: first(x, i) | last(x, i)), paired)

    def paired(kept: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            y = at(kept, i + 1)
            both = (x["gold"] == 0) & (y["gold"] == 1) & same(x, y)
            return F.when(both, F.struct(y["tag"].alias("gold_tag"), x["tag"].alias("pred_tag")))

        return F.filter(F.transform(kept, pair), lambda p: p.isNotNull())

    return bind(F.sort_array(F.concat(side(pred, 0), side(gold, 1))), standing)


def _paired(df: DataFrame) -> DataFrame:
    return with_columns_once(
        df.select("pred_edits", "gold_edits"),
        p=triples(F.col("pred_edits")),
        g=triples(F.col("gold_edits")),
        pairs=_confusions(F.col("pred_edits"), F.col("gold_edits")),
    )


def correction_scores(df: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Micro precision, recall and F1 with and without tags, and what tag errors cost."""
    w = literal_map(weights or WEIGHTS)
    crossing = F.size(
        F.filter(
            "pairs",
            lambda c: F.try_element_at(w, c["gold_tag"]) != F.try_element_at(w, c["pred_tag"]),
        )
    )
    both = F.array_intersect("p", "g")
    sums = _paired(df).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("pred"),
        F.coalesce(F.sum(F.size("g")), F.lit(0)).alias("gold"),
        F.coalesce(F.sum(F.size(both)), F.lit(0)).alias("both"),
        F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("spans"),
        F.coalesce(F.sum(crossing), F.lit(0)).alias("cross"),
        F.count_if((F.size(both) == F.size("p")) & (F.size(both) == F.size("g"))).alias("exact"),
    )
    c = F.col
    p, r = precision_recall(c("both"), c("pred"), c("gold"))
    sp, sr = precision_recall(c("spans"), c("pred"), c("gold"))

    def per(x: Column, n: str) -> Column:
        return F.when(c(n) > 0, x / c(n)).otherwise(0.0)

    return sums.select(
        p.alias("span_tag_precision"),
        r.alias("span_tag_recall"),
        f_beta(p, r, 1.0).alias("span_tag_f1"),
        sp.alias("span_only_precision"),
        sr.alias("span_only_recall"),
        f_beta(sp, sr, 1.0).alias("span_only_f1"),
        per(c("spans") - c("both"), "spans").alias("tag_error_rate"),
        per(c("cross"), "spans").alias("cross_tier_confusion_rate"),
        c("cross").alias("cross_tier_confusions"),
        per(c("exact"), "rows").alias("exact_row_rate"),
        c("pred").alias("predicted_edits"),
        c("gold").alias("gold_edits"),
    )


def tag_confusion(df: DataFrame) -> DataFrame:
    """Counts of (gold tag, predicted tag) over the spans both sides have."""
    return (
        df.select(F.inline(_confusions(F.col("pred_edits"), F.col("gold_edits"))))
        .groupBy("gold_tag", "pred_tag")
        .agg(F.count("*").alias("n"))
    )


def taxonomy_report(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Edits per tag on both sides and each side's share, the catch-all among them."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tag").agg(F.count("*").alias(name))

    both = (
        side(pred, "pred_n")
        .unionByName(side(gold, "gold_n"), allowMissingColumns=True)
        .groupBy("tag")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pred_n", "gold_n")])
    )
    both = written(both)
    n = both.agg(F.sum("pred_n"), F.sum("gold_n")).first()
    for name, total_n in zip(("pred", "gold"), n):
        share = F.col(f"{name}_n") / F.lit(float(max(total_n or 0, 1)))
        both = both.withColumn(f"{name}_rate", share)
    return both


def span_f05_scores(df: DataFrame) -> DataFrame:
    """F0.5 of line edits: ``prediction`` against ``reference`` (markup or lines) on ``text``.

    Plain rows are counted a batch at a time; the expressions are evaluated for the others only.
    """

    sides = ("text", "prediction", "reference")
    held = with_columns_once(df.select(*sides), **{f"_{x}": F.coalesce(x, F.lit("")) for x in sides})
    counted = held.select(*[F.col(f"_{x}").alias(x) for x in sides], span_counts(*[F.col(f"_{x}") for x in sides]).alias("n"))

    # What the batch left for a closer look; for all other rows these columns are null.
    def closer(x: Column) -> Column:
        return F.when(F.col("n").isNull(), x)

    rows = with_columns_once(counted.select("n", *[F.col(x).alias(f"_{x}") for x in sides]), **{x: closer(strip(F.col(f"_{x}"))) for x in sides})
    marked = F.contains("reference", F.lit("[")) & F.contains("reference", F.lit("]"))
    cut = with_columns_once(rows, us=closer(units(F.col("text"))))
    read = with_columns_once(
        cut,
        p=closer(read_lines(F.col("prediction"))),
        g=closer(
            F.when(marked, read_correction(F.col("text"), F.col("reference"), F.col("us"))).otherwise(
                read_lines(F.col("reference"))
            )
        ),
        n_units=F.size("us"),
    )

    def keys(side: str, *parts: str) -> Column:
        """The distinct spans as text, which sets of strings tell apart by hashing, not pair by pair."""
        spans = F.when(F.col(f"{side}.signal").isNull(), F.col(f"{side}.spans"))
        named = F.transform(spans, lambda e: F.concat_ws(" ", *[e[x].cast("string") for x in parts]))
        return F.array_distinct(F.coalesce(named, F.array().cast("array<string>")))

    whole = ("start", "end", "tag", "replacement")
    sets = with_columns_once(
        read,
        pf=closer(keys("p", *whole)), gf=closer(keys("g", *whole)),
        ps=closer(keys("p", "start", "end")), gs=closer(keys("g", "start", "end")),
        p_clean=F.coalesce("n.p_clean", F.col("p.signal").eqNullSafe(F.lit("OK"))),
        g_clean=F.coalesce("n.g_clean", F.col("g.signal").eqNullSafe(F.lit("OK"))),
        valid=F.coalesce("n.valid", fault_of_spans(F.col("p"), F.col("n_units")) == "valid"),
    )

    def summed(name: str, x: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(f"n.{name}", F.size(x)).cast("long")), F.lit(0)).alias(name)

    sums = sets.agg(
        F.count("*").alias("n"),
        F.count_if("valid").alias("valid"),
        F.count_if("g_clean").alias("clean"),
        F.count_if(F.col("g_clean") & F.col("p_clean")).alias("clean_hit"),
        *[summed(x, F.col(x)) for x in ("pf", "gf", "ps", "gs")],
        summed("f_both", F.array_intersect("pf", "gf")),
        summed("s_both", F.array_intersect("ps", "gs")),
    )
    c = F.col
    full_f = f_beta(*precision_recall(c("f_both"), c("pf"), c("gf")), 0.5)
    span_f = f_beta(*precision_recall(c("s_both"), c("ps"), c("gs")), 0.5)
    return sums.select(
        full_f.alias("full_edit_f05"),
        span_f.alias("span_f05"),
        F.when(c("clean") > 0, c("clean_hit") / c("clean")).otherwise(1.0).alias("clean_accuracy"),
        (c("valid") / F.greatest(c("n"), F.lit(1))).alias("valid_output_rate"),
    )


def rewrite_scores(df: DataFrame) -> DataFrame:
    """F0.5 of rewritten sentences: ``prediction`` against the corrected ``reference``.

    Only texts that differ are aligned, a batch of rows at a time; a row without a readable
    reference leaves the edit totals but still counts among the rows.
    """

    def clean(c: Column) -> Column:
        return strip_ends(F.coalesce(c, F.lit("")))

    rows = df.select(
        clean(F.col("text")).alias("text"),
        clean(F.col("prediction")).alias("pred"),
        clean(F.col("reference")).alias("ref"),
    )
    marked = F.contains("ref", F.lit("[")) & F.contains("ref", F.lit("]"))
    rows = with_columns_once(rows, gold=F.when(marked, corrected_text(F.col("ref"))).otherwise(F.col("ref")))
    gold_null = says_null(F.col("gold")) | says_null(F.col("ref"))
    rows = rows.withColumn("gold_null", gold_null).withColumn("pred_null", says_null(F.col("pred")))

    def usable(side: str, needed: Column) -> Column:
        differs = (
            needed & (F.col("text") != "") & (F.col(side) != "") & (F.col("text") != F.col(side))
            & ~says_null(F.col("text"))
        )
        return F.when(differs, F.col(side))

    scored = ~F.col("gold_null")
    both_read = scored & ~F.col("pred_null")
    clean_gold = both_read & (F.col("gold") == F.col("text"))
    sides = rows.select(
        "text", "gold_null", "pred_null", usable("pred", both_read).alias("_pt"), usable("gold", scored).alias("_gt"),
        clean_gold.alias("clean"), (clean_gold & (F.col("pred") == F.col("text"))).alias("clean_hit"),
        (both_read & (F.col("pred") == F.col("gold"))).alias("exact"),
    )
    compared = ("text", "_pt", "_gt")

    # Letters that are not the same for every Unicode version are told apart here, not in the batch.
    def unsure(side: str) -> Column:
        found = (F.octet_length(side) != F.length(side)) & F.rlike(F.col(side), F.lit(unsure_pattern()))
        return F.coalesce(found, F.lit(False))

    odd = unsure("text") | unsure("_pt") | unsure("_gt")
    tokens = F.when(odd, F.array(*[unit_tokens(F.col(side)) for side in compared]))
    counted = sides.withColumn("n", rewrite_counts(*compared, tokens))
    sums = counted.agg(
        F.count("*").alias("n"),
        *[F.sum(f"n.{x}").alias(x) for x in ("p", "g", "both")],
        *[F.count_if(x).alias(x) for x in ("clean", "clean_hit", "exact")],
        F.count_if("gold_null").alias("nulls"),
        F.count_if(F.col("gold_null") & F.col("pred_null")).alias("null_hit"),
    )
    c = F.col
    p, r = precision_recall(c("both"), c("p"), c("g"))

    def share(hit: str, n: str) -> Column:
        return F.when(c(n) > 0, c(hit) / c(n)).otherwise(1.0)

    return sums.select(
        f_beta(p, r, 0.5).alias("edit_f05"),
        p.alias("edit_precision"),
        r.alias("edit_recall"),
        share("clean_hit", "clean").alias("clean_accuracy"),
        (c("exact") / F.greatest(c("n"), F.lit(1))).alias("exact_match"),
        share("null_hit", "nulls").alias("null_accuracy"),
    )


def format_metrics(df: DataFrame) -> DataFrame:
    """Share of rows with an answer, with a valid one, and with an unaltered text.

    ``prediction`` is a nullable struct of the answer fields; a null correction counts as
    unaltered.
    """
    flat = df.select(
        "text",
        F.col("prediction").isNotNull().alias("parsed"),
        F.col("prediction.correction").alias("correction"),
        F.col("prediction.meaning").alias("meaning"),
        F.col("prediction.feedback").alias("feedback"),
        F.coalesce("retries", F.lit(0)).alias("retries"),
    )
    checked = check_rows(flat)
    # Of an answered row, only markup errors and altered texts break the identity.
    same = ~F.coalesce(
        F.col("reject_reason").isin("malformed_edit", "unknown_tag", "empty_edit", "text_altered"),
        F.lit(False),
    )
    return checked.agg(
        F.avg(F.col("parsed").cast("double")).alias("json_parse_rate"),
        F.avg((F.col("parsed") & F.col("reject_reason").isNull()).cast("double")).alias(
            "validity_rate"
        ),
        F.avg((F.col("parsed") & same).cast("double")).alias("strip_identity_rate"),
        F.avg(F.col("retries").cast("double")).alias("retries_per_row"),
    )


#: Pairs, and characters beyond one pair, that are compared at a time.
PAIRS, CHARS = 256, 1 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, the text each belongs to, and how many of it are left."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    return codes, row, left


def _gram_counts(codes: np.ndarray, row: np.ndarray, left: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the distinct n-grams as sorted keys, with the text in the highest bits, and their counts.

    Hashes roll on from n to n + 1 over all texts at once. 56 bits of each are kept.
    """
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        last = codes[n - 1 :]
        h = h[: len(last)] * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(1)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        whole = left[: len(last)] >= n
        keys = np.sort((row[: len(last)].astype(np.uint64)[whole] << np.uint64(56)) | (mixed[whole] >> np.uint64(8)))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        yield keys[first], np.diff(np.append(first, len(keys)))


def overlap_f(left: list[str], right: list[str], order: int) -> np.ndarray:
    """Mean character n-gram F1 of each pair over the orders both texts are long enough for."""
    n_rows = len(left)
    sizes = [np.fromiter(map(len, side), np.int64, n_rows) for side in (left, right)]
    shortest, total = np.minimum(*sizes), np.zeros(n_rows)
    both = zip(_gram_counts(*_codes(left), order), _gram_counts(*_codes(right), order))
    for n, ((a, n_a), (b, n_b)) in enumerate(both, 1):
        # Two sorted sets of keys are merged; what is in both counts as often as in the rarer.
        at = np.searchsorted(a, b)
        same = at < len(a)
        same[same] = a[at[same]] == b[same]
        shared = np.bincount((b[same] >> np.uint64(56)).astype(np.int64), np.minimum(n_a[at[same]], n_b[same]), n_rows)
        able = shortest >= n
        total[able] += 2 * shared[able] / (sizes[0] + sizes[1] - 2 * n + 2)[able]
    orders = np.minimum(order, shortest)
    return np.where(orders > 0, total / np.maximum(orders, 1), 0.0)


@F.pandas_udf(T.DoubleType())
def _chrf(pred: pd.Series, gold: pd.Series, order: pd.Series) -> pd.Series:
    out = np.full(len(pred), np.nan)
    usable = np.flatnonzero(pred.notna().to_numpy() & gold.notna().to_numpy())
    at = 0
    while at < len(usable):
        end, chars = at, 0
        while end < len(usable) and end - at < PAIRS and chars <= CHARS:
            chars += len(pred.iat[usable[end]]) + len(gold.iat[usable[end]])
            end += 1
        some = usable[at:end]
        out[some] = overlap_f(pred.iloc[some].tolist(), gold.iloc[some].tolist(), int(order.iat[0]))
        at = end
    return pd.Series(out).where(pd.Series(out).notna(), None).astype("float64")


def chrf(prediction: Column, reference: Column, order: int = 6) -> Column:
    """Character n-gram F of two columns, in Arrow batches: whole batches are hashed and merged.

    Counting n-grams with higher-order functions took 50 times as long, and exploding them
    would shuffle about twelve rows per character.
    """
    return _chrf(prediction, reference, F.lit(order))


def feedback_chrf(
    df: DataFrame, order: int = 6, pred: str = "pred_feedback", gold: str = "gold_feedback"
) -> DataFrame:
    """Mean character n-gram F over the rows where both sides have feedback."""
    usable = df.where(F.col(pred).isNotNull() & F.col(gold).isNotNull())
    return usable.select(chrf(F.col(pred), F.col(gold), order).alias("c")).agg(
        F.coalesce(F.avg("c"), F.lit(0.0)).alias("chrf"), F.count("*").alias("n")
    )


def judge_summary(df: DataFrame) -> DataFrame:
    """Win and discard rate of pairwise verdicts asked in both orders.

    ``df`` has ``req_uid``, ``order`` (forward or backward) and ``reply``; the first A or B
    counts. A pair is kept when both orders name the same side.
    """
    letter = F.regexp_extract(F.upper("reply"), "[AB]", 0)
    student_first = F.col("order") == "forward"
    choice = F.when(letter != "", (letter == "A") == student_first)

    def of(order: str) -> Column:
        return F.max(F.when(F.col("order") == order, choice))

    pairs = df.groupBy("req_uid").agg(of("forward").alias("f"), of("backward").alias("b"))
    kept = F.coalesce(F.col("f") == F.col("b"), F.lit(False))
    sums = pairs.agg(
        F.count("*").alias("n"),
        F.count_if(kept).alias("consistent"),
        F.count_if(kept & F.col("f")).alias("wins"),
    )
    c = F.col
    return sums.select(
        "n",
        "consistent",
        F.when(c("consistent") > 0, c("wins") / c("consistent")).otherwise(0.0).alias(
            "judge_win_rate"
        ),
        F.when(c("n") > 0, 1 - c("consistent") / c("n")).otherwise(0.0).alias(
            "judge_discard_rate"
        ),
        F.lit("weak").alias("reliability"),
    )


def tag_mix_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of each tag in two corpora (``tags`` arrays) and their ratio."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(
            F.count("*").alias(name)
        )

    both = (
        side(a, "n_a")
        .unionByName(side(b, "n_b"), allowMissingColumns=True)
        .groupBy("tag")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_a", "n_b")])
    )
    both = written(both)
    sums = both.agg(F.sum("n_a"), F.sum("n_b")).first()
    if not sums[0] or not sums[1]:
        raise ValueError("a corpus without tags cannot be compared")
    shares = both.select(
        "tag",
        (F.col("n_a") / F.lit(float(sums[0]))).alias("a"),
        (F.col("n_b") / F.lit(float(sums[1]))).alias("b"),
    )
    return shares.select(
        "tag",
        F.round("a", 4).alias("share_a"),
        F.round("b", 4).alias("share_b"),
        F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("ratio"),
    )


def tag_skew_flags(mix: DataFrame, hi: float = 2.0, lo: float = 0.5) -> DataFrame:
    """Tags that one corpus over- or under-uses; a tag missing on one side has no ratio."""
    ratio = F.when(
        (F.col("share_a") > 0) & (F.col("share_b") > 0), F.col("share_a") / F.col("share_b")
    )
    skew = F.when(ratio >= hi, "over").when(ratio <= lo, "under")
    return mix.withColumn("skew", skew).where(F.col("skew").isNotNull()).select(
        "tag", "share_a", "share_b", "skew"
    )


def hardest_rows(df: DataFrame, k: int = 16, uid: str = "req_uid") -> DataFrame:
    """The ``k`` changed rows with the most and most varied edits."""
    pattern = rf"\[(.*?):({'|'.join(TAGS)})\]"
    tags = F.regexp_extract_all(strip(F.col("correction")), F.lit(pattern), F.lit(2))
    scored = df.where(strip(F.col("text")) != strip(F.col("correction"))).withColumn("_t", tags)
    score = (
        F.size("_t") * 10.0
        + F.size(F.array_distinct("_t")) * 2.0
        + F.least(n_words(F.col("text")), F.lit(40)) * 0.1
    )
    return scored.withColumn("score", score).drop("_t").orderBy(F.desc("score"), uid).limit(k)


def qualitative_rows(df: DataFrame, limit: int = 200, uid: str = "req_uid") -> DataFrame:
    """Reference and prediction side by side, flat, for reading."""
    return (
        df.select(
            "req_uid",
            "text",
            F.col("gold.correction").alias("gold_correction"),
            F.col("prediction.correction").alias("predicted_correction"),
            F.col("gold.meaning").alias("gold_meaning"),
            F.col("prediction.meaning").alias("predicted_meaning"),
            F.col("gold.feedback").alias("gold_feedback"),
            F.col("prediction.feedback").alias("predicted_feedback"),
            F.col("prediction").isNotNull().alias("valid"),
            F.coalesce("retries", F.lit(0)).alias("retries"),
        )
        .orderBy(uid)
        .limit(limit)
    )


def fixture_coverage(df: DataFrame) -> DataFrame:
    """Whether a dataset spans its contract; ``failures`` names what is missing."""
    checked = check_rows(df)
    tags = F.coalesce(F.transform("edits", lambda e: e["tag"]), F.array().cast("array<string>"))
    usage = F.exists(tags, lambda t: t.isin(USAGE_TAGS))
    correctness = F.exists(tags, lambda t: ~t.isin(USAGE_TAGS))
    verbatim = F.col("correction").isNotNull() & (F.size("edits") == 0)
    facts = checked.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("invalid"),
        *[F.count_if(F.col("meaning") == b).alias(f"band_{b}") for b in range(5)],
        F.count_if(correctness).alias(GROUPS[0]),
        F.count_if(usage).alias(GROUPS[1]),
        *[F.count_if(F.array_contains(tags, t)).alias(f"tag_{t}") for t in TAGS],
        F.count_if(F.col("correction").isNull()).alias("unparseable"),
        F.count_if(F.coalesce(verbatim, F.lit(False))).alias("verbatim"),
        F.count_if(F.contains("target", F.lit(" "))).alias("multiword"),
    )
    needed = [f"band_{b}" for b in range(5)] + GROUPS + ["unparseable", "verbatim", "multiword"]
    failures = F.concat(
        F.when(F.col("rows") == 0, F.array(F.lit("empty"))).otherwise(
            F.array().cast("array<string>")
        ),
        F.when(F.col("invalid") > 0, F.array(F.lit("invalid"))).otherwise(
            F.array().cast("array<string>")
        ),
        F.filter(
            F.array(*[F.when(F.col(c) == 0, F.lit(f"no {c}")) for c in needed]),
            lambda x: x.isNotNull(),
        ),
    )
    n_tags = total(F.array(*[F.when(F.col(f"tag_{t}") > 0, 1).otherwise(0) for t in TAGS]))
    return facts.select(
        "rows", "invalid", n_tags.alias("tags"), "unparseable", "verbatim", "multiword",
        F.array_join(failures, ", ").alias("failures"),
    )
