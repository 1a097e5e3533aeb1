"""Scored rollouts: rewards, advantages and sequence probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.arrays import with_columns_once
from marginalia.functions.markup import parse_markup
from marginalia.operators.grading import check_rows, parse_responses
from marginalia.operators.ranking import attach, one_row
from marginalia.operators.scoring import chrf, edit_f1
from marginalia.schemas import MAX_BAND, MIN_BAND, PROBABILITY_FLOOR, STD_FLOOR

# --- fixed values: weights of the reward's terms, and the reward's scopes --------------
REWARD_WEIGHTS = {"edit_f1": 0.5, "meaning": 0.3, "format_valid": 0.2, "strip_mismatch": 1.0}
SCOPES = ["correction_meaning", "full_answer"]
AGGREGATIONS = ["seq_logp", "geo_mean", "arith_mean", "weighted_neglogp"]


def _moments(df: DataFrame, value: Column, prefix: str) -> list[Column]:
    return [F.avg(value).alias(f"{prefix}_mean"), F.stddev_pop(value).alias(f"{prefix}_std")]


def _normal(value: Column, mean: str, std: str) -> Column:
    return F.when(F.col(std) < STD_FLOOR, 0.0).otherwise((value - F.col(mean)) / F.col(std))


GAIN = "gain"


def group_advantage(rollouts: DataFrame, **limits: int) -> DataFrame:
    """Add ``gain`` over the empty baseline and its group-normalised ``advantage``.

    Group means are aggregated with map-side combining and joined back, so a very large
    group is never sorted or held in one task.
    """
    gained = rollouts.withColumn(
        GAIN, F.greatest(F.lit(0.0), F.col("reward") - F.col("empty_reward"))
    )
    groups = gained.groupBy("group_id").agg(
        F.count("*").alias("_n"), *_moments(gained, F.col(GAIN), "_g")
    )
    joined = attach(gained, groups, ["group_id"], "_n", **limits)
    return joined.withColumn("advantage", _normal(F.col(GAIN), "_g_mean", "_g_std")).drop(
        "_g_mean", "_g_std"
    )


def rollout_health(rollouts: DataFrame, kl: float = 0.0) -> DataFrame:
    """One row: reward and advantage spread, gain over empty, length, and dead groups.

    Everything follows from per-group sums: the advantages of a group have mean zero and
    variance one, or are all zero.
    """
    gain = F.greatest(F.lit(0.0), F.col("reward") - F.col("empty_reward"))
    groups = rollouts.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.max("empty_reward").alias("empty"),
        F.stddev_pop("reward").alias("reward_spread"),
        F.stddev_pop(gain).alias("gain_spread"),
    )
    live = F.when(F.col("gain_spread") >= STD_FLOOR, F.col("n")).otherwise(0)
    by_group = groups.agg(
        F.avg("empty").alias("empty_reward"),
        F.sqrt(F.sum(live) / F.sum("n")).alias("advantage_std"),
        F.avg((F.col("reward_spread") < STD_FLOOR).cast("double")).alias("zero_advantage_share"),
    )
    by_row = rollouts.agg(
        *_moments(rollouts, F.col("reward"), "reward"),
        F.avg(F.col("tokens").cast("double")).alias("reasoning_tokens"),
    )
    return one_row(by_group, by_row).select(
        "reward_mean",
        "reward_std",
        "advantage_std",
        "empty_reward",
        (F.col("reward_mean") - F.col("empty_reward")).alias("empty_gap"),
        F.lit(float(kl)).alias("kl"),
        "reasoning_tokens",
        "zero_advantage_share",
    )


def logprob_aggregates(tokens: DataFrame, how: str | list[str], base: str | None = None) -> DataFrame:
    """Rewards per sequence of token probabilities ``(seq_id, p)``, one column for each ``how``.

    ``weighted_neglogp`` weighs each token by the surprise of ``base`` (its own when absent).
    """
    wanted = [how] if isinstance(how, str) else how
    if not wanted or not set(wanted) <= set(AGGREGATIONS):
        raise ValueError(f"unknown aggregation in {wanted}: choose from {AGGREGATIONS}")

    def checked(c: str) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"{c} outside 0..1: "), F.col(c).cast("string")))
        value = F.when(F.col(c).between(0.0, 1.0), F.col(c)).otherwise(bad.cast("double"))
        return F.greatest(value, F.lit(PROBABILITY_FLOOR))

    logs = tokens.select(
        "seq_id",
        checked("p").alias("p"),
        F.log(checked("p")).alias("lp"),
        (-F.log(checked(base or "p"))).alias("w"),
    )
    n, total_lp = F.count("*"), F.sum("lp")
    value = {
        "seq_logp": total_lp,
        "geo_mean": F.exp(total_lp / n),
        "arith_mean": F.avg("p"),
        "weighted_neglogp": F.when(F.sum("w") <= 0, total_lp / n).otherwise(
            F.sum(F.col("w") * F.col("lp")) / F.sum("w")
        ),
    }
    return logs.groupBy("seq_id").agg(n.alias("n_tokens"), *[value[h].alias(h) for h in wanted])


def multi_sample_bound(df: DataFrame, group: str = "group_id", reward: str = "reward", **limits: int) -> DataFrame:
    """``log mean exp`` of each group's rewards, shifted by the group's maximum."""
    tops = df.groupBy(group).agg(F.max(reward).alias("_top"), F.count("*").alias("_n"))
    shifted = attach(df.select(group, reward), tops, [group], "_n", **limits)
    scaled = F.exp(F.col(reward) - F.col("_top"))
    return shifted.groupBy(group).agg(
        F.count("*").alias("samples"), (F.max("_top") + F.log(F.avg(scaled))).alias("bound")
    )


def kl_estimate(tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean per-token log ratio of ``policy`` and ``reference``; both must be present."""
    both = F.col("policy").isNotNull() & F.col("reference").isNotNull()
    odd = F.raise_error(F.lit("policy and reference must align token for token"))
    gap = F.when(both, F.col("policy") - F.col("reference")).otherwise(odd.cast("double"))
    grouped = tokens.groupBy(*by) if by else tokens
    return grouped.agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("kl"), F.count("*").alias("n_tokens"))


def verifiable_reward(
    rollouts: DataFrame,
    gold: DataFrame,
    weights: dict[str, float] | None = None,
    scope: str = "correction_meaning",
) -> DataFrame:
    """Score each rollout's answer against the reference answer of its request.

    ``rollouts`` has ``rollout_id, req_uid`` and a nullable ``answer`` struct, or the raw text of the
    answer as ``answer_text``, of which only a whole JSON object is an answer; ``gold`` has
    ``req_uid, text, correction, meaning, feedback``. No answer scores zero. ``normalised`` is the
    total over what a perfect answer scores, for comparing tracks.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    w = {**REWARD_WEIGHTS, **(weights or {})}
    if set(w) != set(REWARD_WEIGHTS):
        raise ValueError(f"unknown reward weights {sorted(set(w) - set(REWARD_WEIGHTS))}")
    ref = gold.select(
        "req_uid", "text", F.col("correction").alias("gold_correction"),
        F.col("meaning").alias("gold_meaning"), F.col("feedback").alias("gold_feedback"),
    )
    if "answer_text" in rollouts.columns:
        flat = _read_answers(rollouts.select("rollout_id", "req_uid", "answer_text"))
    else:
        flat = rollouts.select("rollout_id", "req_uid", F.col("answer").isNotNull().alias("answered"), "answer.*")
    checked = check_rows(flat.join(ref, "req_uid"))
    parsed = with_columns_once(checked, _g=parse_markup(F.col("gold_correction"))["edits"])
    # Rows rejected for a later reason still carry their edits; markup errors carry none.
    mismatch = F.col("reject_reason").isin(
        "malformed_edit", "unknown_tag", "empty_edit", "text_altered"
    )
    reach = F.lit(float(MAX_BAND - MIN_BAND))
    close = F.when(
        F.col("meaning").between(MIN_BAND, MAX_BAND),
        1.0 - F.abs(F.col("meaning") - F.coalesce("gold_meaning", F.lit(0))) / reach,
    ).otherwise(0.0)
    terms = parsed.select(
        "rollout_id",
        "req_uid",
        "answered",
        edit_f1(F.col("edits"), F.col("_g")).alias("edit_f1"),
        close.alias("meaning"),
        F.when(F.col("reject_reason").isNull(), 1.0).otherwise(0.0).alias("format_valid"),
        F.when(F.coalesce(mismatch, F.lit(False)), 1.0).otherwise(0.0).alias("strip_mismatch"),
        *(
            [chrf(F.col("feedback"), F.col("gold_feedback")).alias("_chrf")]
            if scope == "full_answer"
            else []
        ),
    )
    total = (
        F.col("edit_f1") * w["edit_f1"]
        + F.col("meaning") * w["meaning"]
        + F.col("format_valid") * w["format_valid"]
        - F.col("strip_mismatch") * w["strip_mismatch"]
    )
    perfect = w["edit_f1"] + w["meaning"] + w["format_valid"]
    if scope == "full_answer":
        total = total + F.coalesce(F.col("_chrf"), F.lit(0.0)) * w["format_valid"]

    def scored(c: Column, name: str) -> Column:
        return F.when(F.col("answered"), c).otherwise(0.0).alias(name)

    return terms.select(
        "rollout_id",
        "req_uid",
        *[scored(F.col(t), t) for t in REWARD_WEIGHTS],
        scored(total, "total"),
        scored(total / perfect if perfect else F.lit(0.0), "normalised"),
    )


def _read_answers(rollouts: DataFrame) -> DataFrame:
    """The answer fields of ``answer_text`` where it is one JSON object, and ``answered``."""
    whole = F.startswith(F.schema_of_variant(F.try_parse_json("answer_text")), F.lit("OBJECT"))
    marked = with_columns_once(rollouts, answered=F.coalesce(whole, F.lit(False)))
    return parse_responses(marked.withColumn("reply", F.when(F.col("answered"), F.col("answer_text")))).drop("reply", "answer_text")
