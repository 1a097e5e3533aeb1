"""Request timing: percentiles, goodput, cost, and comparing systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.ranking import (
    checked_small,
    constant_array,
    exact_percentiles,
    global_positions,
    one_row,
)

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def measured(samples: DataFrame) -> DataFrame:
    """Requests that count: neither warm-up nor failed."""
    return samples.where(F.col("ok") & ~F.col("warmup"))


def _named(found: DataFrame, names: dict[str, float], stem: str) -> DataFrame:
    return found.agg(
        *[
            F.max(F.when(F.col("fraction") == f, F.col("value"))).alias(f"{stem}_{n}_s")
            for n, f in names.items()
        ]
    )


def bench_statistics(
    samples: DataFrame, slo_s: float | None = None, cost_per_hour: float = 0.0
) -> DataFrame:
    """One row of latency percentiles, throughput, goodput and cost.

    ``samples`` has ``started_s, ttft_s, latency_s, output_tokens, ok, warmup``. Percentiles
    are exact and interpolated linearly.
    """
    kept = measured(samples)
    c = F.col
    tpot = F.when(
        c("output_tokens") > 1, (c("latency_s") - c("ttft_s")) / (c("output_tokens") - 1)
    )
    counts = c("ok") & ~c("warmup")

    def only(x: Column) -> Column:
        return F.when(counts, x)

    sums = samples.agg(
        F.count_if(counts).alias("requests"),
        F.count_if("warmup").alias("warmup_discarded"),
        F.count_if(~c("warmup") & ~c("ok")).alias("failures"),
        F.coalesce(F.avg(only(tpot)), F.lit(0.0)).alias("tpot_mean_s"),
        (F.max(only(c("started_s") + c("latency_s"))) - F.min(only(c("started_s")))).alias("_span"),
        F.sum(only(c("output_tokens"))).alias("_tokens"),
        F.count_if(counts & (c("latency_s") <= F.lit(slo_s).cast("double"))).alias("_within"),
    )

    def per_second(x: str) -> Column:
        return F.when(c("_span") > 0, c(x) / c("_span")).otherwise(0.0)

    out = [
        "requests", "warmup_discarded", "failures", "tpot_mean_s",
        per_second("_tokens").alias("tokens_per_s"),
    ]
    if slo_s is not None:
        out += [
            F.lit(float(slo_s)).alias("slo_s"),
            per_second("_within").alias("goodput_per_s"),
            (c("_within") / c("requests")).alias("slo_attainment"),
        ]
    if cost_per_hour:
        cost = F.lit(cost_per_hour / 3600) * c("_span") / c("requests") * 1000
        out.append(cost.alias("cost_per_1k_requests"))
    first = {k: PERCENTILES[k] for k in ("p50", "p95")}
    return one_row(
        sums.select(*out),
        _named(exact_percentiles(kept, "ttft_s", list(first.values())), first, "ttft"),
        _named(
            exact_percentiles(kept, "latency_s", list(PERCENTILES.values())), PERCENTILES, "e2e"
        ),
    )


def latency_cdf(samples: DataFrame, points: int = 100) -> DataFrame:
    """The latency distribution at ``points + 1`` even steps."""
    steps = [i / points for i in range(points + 1)]
    return exact_percentiles(measured(samples), "latency_s", steps).select(
        F.col("fraction").alias("p"), F.col("value").alias("latency_s")
    )


def variance_across_runs(df: DataFrame, key: str) -> DataFrame:
    """Spread of one statistic over repeated runs; fewer than two are an error."""
    x, n = F.col(key).cast("double"), F.count(key)
    mean, spread = F.avg(x), F.stddev_pop(x)
    few = F.raise_error(F.lit(f"one run alone has no spread: {key}"))
    return df.agg(
        F.when(n >= 2, n).otherwise(few.cast("long")).alias("runs"),
        mean.alias("mean"),
        spread.alias("std"),
        F.when(mean != 0, spread / mean).otherwise(0.0).alias("relative_std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def quality_per_dollar(df: DataFrame, slo_s: float) -> DataFrame:
    """Add quality per cost: zero over the latency bar, null without a price or a figure."""
    priced = F.col("e2e_p95_s").isNotNull() & F.col("qwk").isNotNull() & (F.col("cost") != 0)
    if "skipped" in df.columns:
        priced = priced & F.col("skipped").isNull()
    value = F.when(F.col("e2e_p95_s") > slo_s, 0.0).otherwise(F.col("qwk") / F.col("cost"))
    return df.withColumn("quality_per_dollar", F.when(priced, value))


def rank_systems(df: DataFrame) -> DataFrame:
    """Systems with a positive quality per dollar and their rank, best first."""
    ranked = df.where(F.col("quality_per_dollar") > 0).withColumn(
        "_worst", -F.col("quality_per_dollar")
    )
    placed = global_positions(ranked, ["_worst", "system"], name="_pos")
    return placed.withColumn("rank", F.col("_pos") + 1).drop("_worst", "_pos")


def best_system(df: DataFrame) -> DataFrame:
    """The system with the highest quality per dollar, the first by name among equals; null when none has one."""
    place = F.when(F.col("quality_per_dollar") > 0, F.struct(-F.col("quality_per_dollar"), "system"))
    return df.agg(F.min_by("system", place).alias("best_quality_per_dollar"))


def pareto_frontier(df: DataFrame, quality: str, latency: str) -> DataFrame:
    """Points no other point beats on both axes.

    A point survives when no faster one is at least as good and none of the same latency is
    better. So the best quality per latency is enough, with a running maximum over smaller
    latencies: a maximum inside each range partition plus that of the partitions before it.
    """
    q, t = F.col(quality), F.col(latency)
    best = df.where(q.isNotNull() & t.isNotNull()).groupBy(t.alias("_t")).agg(F.max(q).alias("_q"))
    frontier = _records(best)
    same = (t == F.col("_t")) & (q == F.col("_q"))
    small = checked_small(frontier)
    return df.join(frontier if small is None else small, same, "inner").drop("_t", "_q")


def _records(best: DataFrame) -> DataFrame:
    """Rows ``(_t, _q)`` whose quality exceeds that of every smaller ``_t``."""
    placed = global_positions(best, ["_t"], name="_pos")
    n = placed.count()
    # Blocks of consecutive positions: few enough for the driver, small enough for a task.
    size = max(1000, -(-n // 4000))
    block = (F.col("_pos") / size).cast("long")
    tops = placed.groupBy(block.alias("b")).agg(F.max("_q").alias("top"))
    found = {r["b"]: float(r["top"]) for r in tops.collect()}
    # Positions have no gaps, so every block up to the last one is there.
    before = [None]
    for b in range(len(found) - 1):
        before.append(found[b] if before[-1] is None else max(before[-1], found[b]))
    earlier = Window.partitionBy(block).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.max("_q").over(earlier)
    outside = F.get(constant_array(before, "double"), block.cast("int"))
    record = F.greatest(inside.cast("double"), outside)
    kept = placed.withColumn("_best", record)
    return kept.where(F.col("_best").isNull() | (F.col("_q") > F.col("_best"))).select("_t", "_q")
