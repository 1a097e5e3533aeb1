"""Gates over metrics, and the report's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.markup import parse_markup
from marginalia.operators.scoring import edit_f1, quadratic_weighted_kappa
from marginalia.functions.arrays import with_columns_once
from marginalia.operators.ranking import one_row
from marginalia.schemas import CEILING_KEYS, WEAK_METRICS, literal_map, literal_rows

# --- fixed values: the gates, the metric each reads, its bar and whether it blocks -----
GATES = [
    ("G1_self_consistency", "self_consistency_qwk", ">=", 0.7, True),
    ("G2_band_coverage", "middle_band_share", ">=", 0.4, True),
    ("G3_format_validity", "format_validity", ">", 0.9, False),
    ("G4_batch_diversity", "mean_distinct2", ">", 0.7, False),
    ("G5_other_tag_share", "other_tag_share", "<", 0.05, False),
    ("G6_batch_single_parity", "batch_single_qwk", ">=", 0.8, False),
    ("G7_manual_review", "manual_review", ">=", 1.0, False),
]
# Second condition of the two blocking gates.
ALSO = [
    ("G1_self_consistency", "self_consistency_edit_f1", ">=", 0.6),
    ("G2_band_coverage", "empty_bands", "<=", 0.0),
]
OPTIONAL_GATES = ["G7_manual_review"]


def pilot_gate(metrics: DataFrame) -> DataFrame:
    """Judge ``metrics(metric, value)`` against the gates: one row per gate.

    A metric that was not measured fails its gate; the manual review is judged only when it
    is given.
    """
    spark = metrics.sparkSession
    gates = literal_rows(
        spark, "name string, metric string, op string, threshold double, blocking boolean", GATES
    )
    also = literal_rows(spark, "name string, metric string, op string, bar double", ALSO)
    value, bar = F.col("value"), F.col("bar")
    holds = (
        F.when(F.col("op") == ">=", value >= bar)
        .when(F.col("op") == ">", value > bar)
        .when(F.col("op") == "<=", value <= bar)
        .otherwise(value < bar)
    )
    rules = gates.select("name", "metric", "op", F.col("threshold").alias("bar"), F.lit(True).alias("main"))
    rules = rules.unionByName(also.withColumn("main", F.lit(False)))
    judged = rules.join(metrics, "metric", "left").withColumn(
        "ok", F.coalesce(holds, F.lit(False))
    )
    per_gate = judged.groupBy("name").agg(
        F.max(F.when(F.col("main"), value)).alias("value"), F.min("ok").alias("passed")
    )
    return (
        per_gate.join(gates, "name")
        .where(F.col("value").isNotNull() | ~F.col("name").isin(OPTIONAL_GATES))
        .select("name", F.round("value", 4).alias("value"), "threshold", "passed", "blocking")
    )


def pilot_verdict(gates: DataFrame) -> DataFrame:
    """Whether all gates hold, and whether those do that block."""
    return gates.agg(
        F.coalesce(F.min("passed"), F.lit(True)).alias("passed"),
        F.coalesce(F.min(F.col("passed") | ~F.col("blocking")), F.lit(True)).alias("blocking_passed"),
    )


def self_consistency(pass0: DataFrame, pass1: DataFrame) -> DataFrame:
    """Band kappa and mean edit F1 between two gradings of the same texts."""

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(
            "req_uid", F.col("meaning").alias(f"m{n}"), F.col("correction").alias(f"c{n}")
        )

    both = side(pass0, 0).join(side(pass1, 1), "req_uid")
    parsed = with_columns_once(
        both, p0=parse_markup(F.col("c0"))["edits"], p1=parse_markup(F.col("c1"))["edits"]
    )
    kappa = quadratic_weighted_kappa(both, "m0", "m1").select("qwk")
    f1 = parsed.agg(
        F.count("*").alias("pairs"),
        F.coalesce(F.avg(edit_f1(F.col("p0"), F.col("p1"))), F.lit(0.0)).alias("edit_f1"),
    )
    return one_row(kappa, f1)


def reject_rate_gate(df: DataFrame, ceiling: float = 0.10, reason: str = "reject_reason") -> DataFrame:
    """Rejected rows, their share, and whether it stays within the ceiling."""
    rate = F.coalesce(F.avg(F.col(reason).isNotNull().cast("double")), F.lit(0.0))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(reason).isNotNull()).alias("rejected"),
        rate.alias("reject_rate"),
        (rate <= ceiling).alias("passed"),
    )


def ceiling_report(metrics: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Metrics ``(grp, metric, value)`` with reliability and their share of the ceiling."""
    path = F.concat_ws(".", "grp", "metric")
    named = metrics.withColumn("ceiling_key", F.try_element_at(literal_map(CEILING_KEYS), path))
    bars = ceilings.select(F.col("metric").alias("ceiling_key"), F.col("value").alias("ceiling"))
    joined = named.join(bars, "ceiling_key", "left")
    weak = F.when(F.col("metric").isin(WEAK_METRICS), "weak").otherwise("strong")
    return joined.select(
        "grp",
        "metric",
        "value",
        weak.alias("reliability"),
        "ceiling",
        F.when(F.col("ceiling") > 0, F.col("value") / F.col("ceiling")).alias("fraction"),
    )


REPORT_FIELDS = ["stage", "split", "rows", "lineage"]


def report_contract(metrics: DataFrame) -> DataFrame:
    """What keeps a report from standing alone: missing fields and untagged numbers."""
    absent = [c for c in [*REPORT_FIELDS, "reliability", "ceiling"] if c not in metrics.columns]
    if absent:
        raise ValueError(f"the report has no column {absent}")
    faults = F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REPORT_FIELDS],
        F.when(F.col("value").isNotNull() & F.col("reliability").isNull(), "no reliability tag"),
    )
    return metrics.select(
        "grp", "metric", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("problem")
    )
