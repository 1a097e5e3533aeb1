"""Confidence calibration, and cut points on the penalty distribution."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.markup import band_of
from marginalia.operators.grading import group_penalties
from marginalia.operators.ranking import global_positions, value_positions, written
from marginalia.schemas import MAX_BAND, MIN_BAND, BandConfig


def equal_mass_rank(df: DataFrame, col: str, bins: int, uid: str = "row_id") -> DataFrame:
    """Add the global ``rank`` by ``col`` (ties by id) and the ``bin`` of near-equal count."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    ranked = global_positions(df.where(F.col(col).isNotNull()), [col, uid], name="rank")
    n = ranked.count()
    if n == 0:
        raise ValueError("every confidence is missing")
    bins = min(bins, n)
    edges = [round(n * (i + 1) / bins) for i in range(bins - 1)]
    place = F.lit(0)
    for edge in edges:
        place = place + F.when(F.col("rank") >= edge, 1).otherwise(0)
    return ranked.withColumn("bin", place)


def bin_cuts(df: DataFrame, col: str, bins: int, uid: str = "row_id") -> list[tuple]:
    """``(value, id)`` of the first row of every bin but the first, in the order of value and id.

    Equal values are counted; an edge between two values needs no more than that. Only rows whose
    value has an edge inside are ordered by id, and only value and id of them move.
    """
    if bins < 1:
        raise ValueError("at least one bin is needed")
    counted = written(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("copies")))
    n = counted.agg(F.sum("copies")).first()[0]
    if not n:
        raise ValueError("every confidence is missing")
    bins = min(bins, n)
    edges = [round(n * (i + 1) / bins) for i in range(bins - 1)]
    asked = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array().cast("array<bigint>")
    after = F.col("first") + F.col("copies")
    # At most one row for each edge.
    held = (
        global_positions(counted, ["value"], weight="copies", name="first")
        .select("value", "first", "copies", F.explode(F.filter(asked, lambda e: (e >= F.col("first")) & (e < after))).alias("edge"))
        .collect()
    )
    cuts = {r["edge"]: (r["value"], None) for r in held if r["edge"] == r["first"]}
    inside = {r["value"]: r for r in held if r["edge"] > r["first"]}
    if inside:
        rows = df.where(F.col(col).isin(list(inside))).select(F.col(col).alias("value"), F.col(uid).alias("id"))
        ranked = global_positions(rows, ["value", "id"], name="rank")
        # Where a value begins among the tied rows, and so the edges inside it.
        begins = dict(zip(sorted(inside), accumulate((inside[v]["copies"] for v in sorted(inside)), initial=0)))
        at = {begins[r["value"]] + r["edge"] - r["first"]: r["edge"] for r in held if r["edge"] > r["first"]}
        for r in ranked.where(F.col("rank").isin(list(at))).collect():
            cuts[at[r["rank"]]] = (r["value"], r["id"])
    return [cuts[e] for e in edges]


def reliability_bins(
    df: DataFrame, conf: str, correct: str, bins: int = 10, uid: str = "row_id"
) -> DataFrame:
    """Bounds, count, mean confidence and accuracy of equal-count bins.

    The rows are aggregated where they are, by comparing them with the cuts. Rows alike in
    confidence and id share a bin.
    """
    rows = df.where(F.col(conf).isNotNull())
    place = F.lit(0)
    for value, first_id in bin_cuts(rows, conf, bins, uid):
        beyond = F.col(conf) >= F.lit(value)
        if first_id is not None:
            beyond = (F.col(conf) > F.lit(value)) | ((F.col(conf) == F.lit(value)) & (F.col(uid) >= F.lit(first_id)))
        place = place + F.when(beyond, 1).otherwise(0)
    return rows.groupBy(place.alias("bin")).agg(
        F.min(conf).alias("lower"),
        F.max(conf).alias("upper"),
        F.count("*").alias("count"),
        F.avg(conf).alias("mean_confidence"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
    )


def ece(bins: DataFrame) -> DataFrame:
    """Count-weighted mean gap between confidence and accuracy."""
    c = F.col
    n = F.sum("count")
    gap = F.abs(c("mean_confidence") - c("accuracy"))
    return bins.agg(
        (F.sum(c("count") * gap) / n).alias("ece"),
        n.alias("n"),
        (F.sum(c("count") * c("mean_confidence")) / n).alias("mean_confidence"),
        (F.sum(c("count") * c("accuracy")) / n).alias("accuracy"),
    )


def uniform_thresholds(penalties: DataFrame, col: str = "penalty") -> DataFrame:
    """Cut points at the nearest-rank quintiles of the pooled penalties."""
    placed = value_positions(penalties, col)
    n = placed.agg(F.max("after")).first()[0]
    if not n:
        raise ValueError("there is no penalty to take quintiles of")
    steps = MAX_BAND - MIN_BAND
    wanted = [
        (i, min(n - 1, max(0, round(i / (steps + 1) * (n - 1))))) for i in range(1, steps + 1)
    ]
    asked = F.array(
        *[F.struct(F.lit(i).alias("cut"), F.lit(p).cast("long").alias("p")) for i, p in wanted]
    )
    mine = F.filter(asked, lambda a: (a["p"] >= F.col("first")) & (a["p"] < F.col("after")))
    return placed.select(F.explode(mine).alias("a"), "value").select(
        F.col("a.cut").alias("cut"), F.col("value").alias("threshold")
    )


def threshold_guard(thresholds: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """Whether the cut points are distinct, with the share of zero penalties when given."""
    facts = thresholds.agg(
        F.count("*").alias("cuts"),
        F.count_distinct("threshold").alias("distinct_cuts"),
        (F.count("*") == F.count_distinct("threshold")).alias("passed"),
    )
    if penalties is None:
        return facts
    zero = F.coalesce(F.avg((F.col("penalty") == 0).cast("double")), F.lit(0.0))
    share = penalties.agg(zero.alias("z")).first()[0]
    return facts.withColumn("zero_share", F.lit(float(share)))


def assert_distinct_thresholds(thresholds: DataFrame, penalties: DataFrame) -> list[float]:
    """The ascending cut points, or an error naming the mass at zero."""
    facts = threshold_guard(thresholds, penalties).first()
    if not facts["passed"]:
        raise ValueError(
            f"duplicate cut points erase a band; {facts['zero_share']:.1%} of penalties are zero"
        )
    return [r["threshold"] for r in thresholds.orderBy("cut").collect()]


def calibrate(rows: DataFrame, config: BandConfig) -> BandConfig:
    """The next version of a config, with cut points at the quintiles of the pooled penalties of ``rows``.

    ``rows`` has ``text`` and ``correction``. Cut points that fall together are an error, and then
    there is no new config.
    """
    penalties = written(group_penalties(rows, config=config).select("grp", "penalty"))
    return config.with_thresholds(assert_distinct_thresholds(uniform_thresholds(penalties), penalties))


def calibrated_distribution(
    penalties: DataFrame, thresholds: list[float], group: str = "grp"
) -> DataFrame:
    """Rows per group and band under the given cut points."""
    band = band_of(F.col("penalty"), thresholds)
    return penalties.groupBy(F.col(group).alias("grp"), band.alias("band")).agg(
        F.count("*").alias("n")
    )


def fit_thresholds(df: DataFrame, penalty: str = "penalty", band: str = "band") -> DataFrame:
    """Midpoints between the mean penalties of neighbouring bands; every band is required."""

    def mean(b: int) -> Column:
        found = F.avg(F.when(F.col(band) == b, F.col(penalty)))
        absent = F.raise_error(F.lit(f"no row of band {b} to fit a cut from"))
        return F.coalesce(found, absent.cast("double")).alias(f"m{b}")

    means = df.agg(*[mean(b) for b in range(MIN_BAND, MAX_BAND + 1)])
    cuts = F.array(
        *[
            F.struct(
                F.lit(MAX_BAND + 1 - b).alias("cut"),
                ((F.col(f"m{b}") + F.col(f"m{b - 1}")) / 2).alias("threshold"),
            )
            for b in range(MAX_BAND, MIN_BAND, -1)
        ]
    )
    return means.select(F.inline(cuts))


def confusable_weight_guard(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of easily confused tags and whether they weigh the same."""

    def side(name: str) -> DataFrame:
        return tags.select(F.col("tag").alias(name), F.col("weight").alias(f"weight_{name}"))

    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    same = F.col("weight_a").eqNullSafe(F.col("weight_b"))
    return joined.select("a", "b", "weight_a", "weight_b", same.alias("passed"))
