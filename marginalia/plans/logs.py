"""Registered queries: logs, streams, rollouts, timing, whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import shape_fault
from marginalia.operators import curate as C
from marginalia.operators import log as L
from marginalia.operators import rollouts as O
from marginalia.operators import timing as M
from marginalia.plans import derive as D
from marginalia.plans import flows
from marginalia.plans.curation import SHAPE, batch_responses, batch_specs, bucket_sql
from marginalia.plans.flows import process_dataset as process_flow
from marginalia.plans.flows import process_with_report
from marginalia.plans.markup import replies
from marginalia.plans.registry import SHARED, query, scratch, table
from marginalia.plans.scores import rounded
from marginalia.streaming import changelog as G

# --- logs and caches ---------------------------------------------------------------------

SHARED["current"] = """
SELECT key, seq, event_type, value, response FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM event_log) WHERE r = 1
"""


@query("SELECT key, seq, event_type, value FROM current WHERE response IS NOT NULL")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    live = L.latest_by_key(D.event_log(spark, d), "key", "seq", F.col("response").isNull())
    return live.select("key", "seq", "event_type", "value")


@query("""
SELECT req_uid, p AS pass_index FROM (SELECT 'u' || c_custkey AS req_uid FROM customer), (VALUES (0), (1)) v(p)
WHERE req_uid || CASE p WHEN 1 THEN '#p1' ELSE '' END NOT IN (SELECT 'u' || user_id || CASE WHEN event_type = 'view' THEN '#p1' ELSE '' END FROM events)
""")
def pending_requests(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("req_uid")
    )
    suffix = F.when(F.col("event_type") == "view", "#p1").otherwise("")
    log = D.event_log(spark, d).select(F.concat("key", suffix).alias("req_uid"))
    first, second = (L.pending_requests(asked, log, p).withColumn("pass_index", F.lit(p)) for p in (0, 1))
    return first.unionByName(second)


@query("""
SELECT e.event_id, c.response, c.response IS NOT NULL AS hit FROM events e LEFT JOIN (
  SELECT props, event_type, CASE WHEN value >= 20 THEN CAST(event_id AS VARCHAR) END AS response FROM (
    SELECT *, row_number() OVER (PARTITION BY props, event_type ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'view') WHERE r = 1) c
  ON c.props = e.props AND c.event_type = e.event_type
""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every event asks; all but views have answered before, small values as deletions."""
    events = table(spark, d, "events")
    asked = events.select(
        "event_id", F.col("event_type").alias("model"), F.lit("rubric-1").alias("prompt_hash"), F.col("props").alias("request")
    )
    answers = events.where(F.col("event_type") != "view").select(
        L.cache_key(F.col("event_type"), F.lit("rubric-1"), F.col("props")).alias("key"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") >= 20, F.col("event_id").cast("string")).alias("response"),
    )
    return L.cache_lookup(asked, answers).select("event_id", "response", "hit")


@query("""
SELECT count(*) AS calls, count(*) FILTER (event_type = 'view') AS cache_hits, count(*) FILTER (event_type <> 'view') AS network_calls,
  round(count(*) FILTER (event_type = 'view') / count(*), 4) AS hit_rate, CAST(sum(event_id % 3) AS BIGINT) AS retries, count(*) FILTER (event_type = 'error') AS failures,
  CAST(sum(event_id % 500) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 40) AS BIGINT) AS completion_tokens, round(sum(value), 2) AS cost FROM events
""")
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    calls = table(spark, d, "events").select(
        (F.col("event_type") == "view").alias("cache_hit"), (n % 3).alias("retries"),
        (F.col("event_type") == "error").alias("failed"), (n % 500).alias("prompt_tokens"),
        (n % 40).alias("completion_tokens"), F.col("value").alias("cost"),
    )
    return L.usage_report(calls).withColumn("cost", F.round("cost", 2))


@query("""
SELECT count(DISTINCT event_type) AS prompts, count(*) FILTER (event_type <> 'click') AS foreign_rows, false AS passed FROM events WHERE event_id % 4 <> 0
""")
def rubric_guard(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(
        F.col("event_type").alias("prompt_hash"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 5).alias("meaning")
    )
    return L.rubric_guard(log, "click")


# --- streams -----------------------------------------------------------------------------


def graded_lines(spark: SparkSession, d: str) -> DataFrame:
    """The replies as log lines; some are torn."""
    rows = replies(spark, d).join(D.marked(spark, d).select(F.col("req_uid").alias("_id"), "text", "doc_id"), L.request_of(F.col("req_uid")) == F.col("_id"))
    record = F.to_json(F.struct(F.col("_id").alias("req_uid"), F.col("doc_id").alias("seq"), "text", "reply"))
    torn = F.substring(record, F.lit(1), F.length(record) - 4)
    return rows.select("doc_id", F.when(F.col("doc_id") % 37 == 5, torn).otherwise(record).alias("value"))


def in_two_waves(spark: SparkSession, lines: DataFrame, early: object, step: object) -> None:
    """Write part of the log, run the stream, write the rest, run it again."""
    path = scratch(spark)
    for wave in (early, ~early):
        lines.where(wave).select("value").write.mode("append").text(f"{path}/log")
        step(f"{path}/log", f"{path}/checkpoint", f"{path}/out")
    return f"{path}/out"


SHARED["log_outcomes"] = """
SELECT req_uid, CASE WHEN doc_id % 37 = 5 THEN 'bad_line' ELSE outcome END AS reject_reason FROM reply_verdicts
"""


@query("SELECT CASE WHEN reject_reason = 'bad_line' THEN NULL ELSE req_uid END AS req_uid, reject_reason FROM log_outcomes")
def stream_log_ingest(spark: SparkSession, d: str) -> DataFrame:
    out = in_two_waves(
        spark, graded_lines(spark, d), F.col("doc_id") % 3 == 0,
        lambda log, ckpt, out: G.stream_log_ingest(spark, log, ckpt, out),
    )
    return spark.read.parquet(out).select("req_uid", "reject_reason")


@query("SELECT coalesce(reject_reason, 'ok') AS reason, count(*) AS n FROM log_outcomes GROUP BY 1")
def stream_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    def step(log: str, ckpt: str, out: str) -> None:
        rows = G.graded_log(G.read_log_stream(spark, log, G.LOG, "req_uid"))
        G.run_updates(G.stream_reject_counts(rows), ckpt, f"{out}/{'second' if written else 'first'}")
        written.append(True)

    written: list[bool] = []
    out = in_two_waves(spark, graded_lines(spark, d), F.col("doc_id") % 3 == 0, step)
    return G.settled(spark, f"{out}/*", "reason")


EVENT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("response", T.StringType()),
    ]
)


@query("SELECT key, seq, event_type, value FROM current WHERE response IS NOT NULL")
def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    events = D.event_log(spark, d)
    lines = events.select("seq", F.to_json(F.struct(*events.columns)).alias("value"))

    def step(log: str, ckpt: str, out: str) -> None:
        rows = G.read_log_stream(spark, log, EVENT, "key").drop("bad_line")
        states.append(G.latest_rows(spark, out, EVENT, "key", "seq", every=2))
        G.stream_state(rows, ckpt, states[-1])

    states: list[G.Generations] = []
    in_two_waves(spark, lines, F.col("seq") % 2 == 1, step)
    return states[-1].read().where(F.col("response").isNotNull()).drop("response")


TIMED = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
    ]
)


@query("""
SELECT window_start, kind, CAST(count(*) FILTER (NOT late) AS BIGINT) AS n, CAST(count(*) FILTER (late) AS BIGINT) AS late FROM (
  SELECT w AS window_start, event_type AS kind, second AND w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_id % 4 <> 0) - INTERVAL 6 HOUR AS late
  FROM (SELECT *, date_trunc('day', ts) AS w, event_id % 4 = 0 AS second FROM events)) GROUP BY window_start, kind
""")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type; a quarter of them come in a second wave, most of those too late."""
    events = table(spark, d, "events").select("event_id", "ts", "event_type").coalesce(16)
    lines = events.select("event_id", F.to_json(F.struct(*events.columns)).alias("value"))
    last: list[G.Generations] = []

    def step(log: str, ckpt: str, out: str) -> None:
        rows = G.read_log_stream(spark, log, TIMED, "event_id").drop("bad_line")
        last.append(G.window_counts(spark, out))
        G.stream_event_counts(rows, ckpt, last[-1], "ts", "event_type", "1 day", "6 HOURS")

    in_two_waves(spark, lines, F.col("event_id") % 4 != 0, step)
    return G.event_counts(last[-1])


# --- rollouts ----------------------------------------------------------------------------

SHARED["gains"] = "SELECT *, greatest(0.0::DOUBLE, reward - empty_reward) AS gain FROM rollouts"
SHARED["advantages"] = """
SELECT *, CASE WHEN s < 1e-6 THEN 0.0::DOUBLE ELSE (gain - m) / s END AS advantage FROM (
  SELECT *, avg(gain) OVER (PARTITION BY group_id) AS m, stddev_pop(gain) OVER (PARTITION BY group_id) AS s, stddev_pop(reward) OVER (PARTITION BY group_id) AS sr FROM gains)
"""


@query("SELECT rollout_id, round(gain, 6) AS gain, round(advantage, 5) AS advantage FROM advantages")
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    found = O.group_advantage(D.rollouts(spark, d))
    return found.select("rollout_id", F.round("gain", 6).alias("gain"), F.round("advantage", 5).alias("advantage"))


@query("""
SELECT round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, round(stddev_pop(advantage), 6) AS advantage_std,
  round(any_value(e), 6) AS empty_reward, round(avg(reward) - any_value(e), 6) AS empty_gap, 0.0::DOUBLE AS kl, round(avg(tokens), 6) AS reasoning_tokens, round(any_value(z), 6) AS zero_advantage_share
FROM advantages, (SELECT avg(e) AS e, avg((sr < 1e-6)::INT) AS z FROM (SELECT group_id, max(empty_reward) AS e, any_value(sr) AS sr FROM advantages GROUP BY group_id))
""")
def rollout_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.rollout_health(D.rollouts(spark, d)))


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("seq_id"), F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double")
    p = 1.0 / (1.0 + F.exp(-4.0 * x))
    base = F.when(F.col("pos") % 17 == 0, 0.0).otherwise(1.0 / (1.0 + F.exp(-x)))
    return rows.select("seq_id", "pos", p.alias("p"), base.alias("base_p"))


SHARED["token_rows"] = """
SELECT vec_id AS seq_id, pos, 1.0::DOUBLE / (1.0::DOUBLE + exp(-4.0::DOUBLE * x)) AS p, CASE WHEN pos % 17 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-x)) END AS base_p
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
"""


@query("""
SELECT seq_id, count(*) AS n_tokens, round(sum(ln(p)), 5) AS seq_logp, round(exp(avg(ln(p))), 6) AS geo_mean, round(avg(p), 6) AS arith_mean,
  round(sum(-ln(greatest(base_p, 1e-12::DOUBLE)) * ln(p)) / sum(-ln(greatest(base_p, 1e-12::DOUBLE))), 5) AS weighted_neglogp FROM token_rows GROUP BY seq_id
""")
def logprob_aggregates(spark: SparkSession, d: str) -> DataFrame:
    found = O.logprob_aggregates(token_rows(spark, d), list(O.AGGREGATIONS), "base_p")
    digits = {"seq_logp": 5, "geo_mean": 6, "arith_mean": 6, "weighted_neglogp": 5}
    return found.select("seq_id", "n_tokens", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("SELECT group_id, count(*) AS samples, round(max(reward) + ln(avg(exp(reward - t))), 6) AS bound FROM (SELECT *, max(reward) OVER (PARTITION BY group_id) AS t FROM rollouts) GROUP BY group_id")
def multi_sample_bound(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.multi_sample_bound(D.rollouts(spark, d)))


@query("SELECT seq_id, round(avg(ln(p) - ln(greatest(base_p, 1e-12::DOUBLE))), 6) AS kl, count(*) AS n_tokens FROM token_rows GROUP BY seq_id")
def kl_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = token_rows(spark, d).select(
        "seq_id", F.log("p").alias("policy"), F.log(F.greatest("base_p", F.lit(1e-12))).alias("reference")
    )
    return rounded(O.kl_estimate(rows, ["seq_id"]))


@query("""
SELECT rollout_id, round(CASE WHEN answered THEN f1 ELSE 0.0 END, 6) AS edit_f1, round(CASE WHEN answered THEN close ELSE 0.0 END, 6) AS meaning,
  CASE WHEN answered AND reject_reason IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format_valid, CASE WHEN answered AND bad THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strip_mismatch,
  round(CASE WHEN answered THEN 0.5 * f1 + 0.3 * close + CASE WHEN reject_reason IS NULL THEN 0.2 ELSE 0.0 END - CASE WHEN bad THEN 1.0 ELSE 0.0 END ELSE 0.0 END, 6) AS total
FROM (SELECT v.req_uid AS rollout_id, (doc_id + line_no) % 14 <> 0 AS answered, reject_reason, coalesce(reject_reason IN ('malformed_edit', 'unknown_tag', 'empty_edit', 'text_altered'), false) AS bad,
    CASE WHEN meaning BETWEEN 0 AND 4 THEN 1.0::DOUBLE - abs(meaning - gold_meaning) / 4.0::DOUBLE ELSE 0.0::DOUBLE END AS close,
    CASE WHEN coalesce(np, 0) + coalesce(ng, 0) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(nb, 0) / (coalesce(np, 0) + coalesce(ng, 0)) END AS f1
  FROM verdicts v LEFT JOIN (SELECT req_uid, sum(r) AS np, sum(g) AS ng, sum(r * g) AS nb FROM reward_sides GROUP BY req_uid) s ON s.req_uid = v.req_uid)
""")
def verifiable_reward(spark: SparkSession, d: str) -> DataFrame:
    """The raw gradings as rollouts, against the predicted side as their reference."""
    m = D.marked(spark, d)
    key = F.col("doc_id") + F.col("line_no")
    made = m.select(
        F.col("req_uid").alias("rollout_id"), "req_uid",
        F.when(key % 14 != 0, F.struct("correction", "meaning", "feedback")).alias("answer"),
    )
    gold = m.select("req_uid", "text", F.col("pred").alias("correction"), F.col("gold_meaning").alias("meaning"), F.col("gold_feedback").alias("feedback"))
    return rounded(O.verifiable_reward(made, gold).drop("req_uid", "normalised"))


SHARED["feedback_grams"] = """
SELECT p, g, n, side, gram, count(*) AS c FROM (
  SELECT p, g, n, side, unnest([array_to_string(ch[i:i + n - 1], '') FOR i IN range(1, len(ch) - n + 2)]) AS gram
  FROM (SELECT p, g, 'p' AS side, string_split(p, '') AS ch FROM feedback_pairs UNION ALL SELECT p, g, 'g', string_split(g, '') FROM feedback_pairs),
       (SELECT unnest(range(1, 7)) AS n) WHERE len(ch) >= n) GROUP BY p, g, n, side, gram
"""
SHARED["feedback_pairs"] = "SELECT DISTINCT feedback AS p, gold_feedback AS g FROM verdicts WHERE feedback IS NOT NULL AND gold_feedback IS NOT NULL AND feedback <> '' AND gold_feedback <> ''"
SHARED["feedback_f"] = """
SELECT p, g, avg(2.0::DOUBLE * nb / (np + ng)) AS f FROM (
  SELECT p, g, n, sum(least(cp, cg)) AS nb, sum(cp) AS np, sum(cg) AS ng FROM (
    SELECT p, g, n, gram, coalesce(sum(c) FILTER (side = 'p'), 0) AS cp, coalesce(sum(c) FILTER (side = 'g'), 0) AS cg FROM feedback_grams GROUP BY p, g, n, gram)
  GROUP BY p, g, n) WHERE np > 0 AND ng > 0 GROUP BY p, g
"""


@query("""
SELECT rollout_id, round(CASE WHEN answered THEN t ELSE 0.0 END, 6) AS total, round(CASE WHEN answered THEN t ELSE 0.0 END, 6) AS normalised
FROM (SELECT v.req_uid AS rollout_id, (doc_id + line_no) % 14 > 1 AS answered,
    0.5 * CASE WHEN coalesce(np, 0) + coalesce(ng, 0) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(nb, 0) / (coalesce(np, 0) + coalesce(ng, 0)) END
    + 0.3 * CASE WHEN meaning BETWEEN 0 AND 4 THEN 1.0::DOUBLE - abs(meaning - gold_meaning) / 4.0::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN reject_reason IS NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
    - CASE WHEN coalesce(reject_reason IN ('malformed_edit', 'unknown_tag', 'empty_edit', 'text_altered'), false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + 0.2 * coalesce(f, 0.0::DOUBLE) AS t
  FROM verdicts v LEFT JOIN (SELECT req_uid, sum(r) AS np, sum(g) AS ng, sum(r * g) AS nb FROM reward_sides GROUP BY req_uid) s ON s.req_uid = v.req_uid
  LEFT JOIN feedback_f x ON x.p = v.feedback AND x.g = v.gold_feedback)
""")
def verifiable_reward_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole answer is rewarded, read from the raw text of the rollout; some texts are no object."""
    m = D.marked(spark, d)
    key = F.col("doc_id") + F.col("line_no")
    answer = F.to_json(F.struct("correction", "meaning", "feedback"), {"ignoreNullFields": "false"})
    text = F.when(key % 14 == 0, F.concat(F.lit("So: "), answer)).when(key % 14 == 1, "[1]").otherwise(answer)
    made = m.select(F.col("req_uid").alias("rollout_id"), "req_uid", text.alias("answer_text"))
    gold = m.select("req_uid", "text", F.col("pred").alias("correction"), F.col("gold_meaning").alias("meaning"), F.col("gold_feedback").alias("feedback"))
    return rounded(O.verifiable_reward(made, gold, scope="full_answer").select("rollout_id", "total", "normalised"))


# The raw grading's edits: none when its markup is broken, moved when its text is longer.
SHARED["raw_edits"] = """
SELECT g.req_uid, g."start" + moved AS "start", g."end" + moved AS "end", tag FROM (
  SELECT g.*, CASE WHEN (m.doc_id + m.line_no) % 17 = 4 AND original = '' AND replacement = 'too' THEN 1 ELSE 0 END AS moved
  FROM gold_pairs g JOIN marked m ON m.req_uid = g.req_uid WHERE (m.doc_id + m.line_no) % 17 NOT IN (1, 2, 3)) g
"""
SHARED["reward_sides"] = """
SELECT req_uid, "start", "end", tag, max(r) AS r, max(g) AS g FROM (
  SELECT req_uid, "start", "end", tag, 1 AS r, 0 AS g FROM raw_edits UNION ALL SELECT req_uid, "start", "end", tag, 0, 1 FROM pred_pairs)
GROUP BY req_uid, "start", "end", tag
"""

# --- timing ------------------------------------------------------------------------------


@query("""
SELECT count(*) AS requests, (SELECT count(*) FILTER (warmup) FROM samples) AS warmup_discarded, (SELECT count(*) FILTER (NOT warmup AND NOT ok) FROM samples) AS failures,
  round(avg(CASE WHEN output_tokens > 1 THEN (latency_s - ttft_s) / (output_tokens - 1) END), 6) AS tpot_mean_s, round(sum(output_tokens) / any_value(span), 6) AS tokens_per_s,
  60.0::DOUBLE AS slo_s, round(count(*) FILTER (latency_s <= 60) / any_value(span), 6) AS goodput_per_s, round(count(*) FILTER (latency_s <= 60) / count(*), 6) AS slo_attainment,
  round(2.5::DOUBLE / 3600 * any_value(span) / count(*) * 1000, 6) AS cost_per_1k_requests, round(quantile_cont(ttft_s, 0.5), 6) AS ttft_p50_s, round(quantile_cont(ttft_s, 0.95), 6) AS ttft_p95_s,
  round(quantile_cont(latency_s, 0.5), 6) AS e2e_p50_s, round(quantile_cont(latency_s, 0.95), 6) AS e2e_p95_s, round(quantile_cont(latency_s, 0.99), 6) AS e2e_p99_s
FROM timed, (SELECT max(started_s + latency_s) - min(started_s) AS span FROM timed)
""")
def bench_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.bench_statistics(D.samples(spark, d), slo_s=60.0, cost_per_hour=2.5))


@query("SELECT i / 100::DOUBLE AS p, round(v[lo + 1] * (1 - (at - lo)) + v[hi + 1] * (at - lo), 6) AS latency_s FROM (SELECT i, v, i / 100::DOUBLE * (len(v) - 1) AS at, CAST(floor(i / 100::DOUBLE * (len(v) - 1)) AS INTEGER) AS lo, CAST(ceil(i / 100::DOUBLE * (len(v) - 1)) AS INTEGER) AS hi FROM (SELECT list(latency_s ORDER BY latency_s) AS v FROM timed), (SELECT unnest(range(101)) AS i))".replace(" at", " pos").replace("(at", "(pos"))
def latency_cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.latency_cdf(D.samples(spark, d)))


@query("""
SELECT count(*) AS runs, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(stddev_pop(o_totalprice) / avg(o_totalprice), 4) AS relative_std,
  min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders
""")
def variance_across_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.variance_across_runs(table(spark, d, "orders"), "o_totalprice"), 4)


def systems(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.col("c_name").alias("system"), (F.abs("c_acctbal") / 100.0).alias("qwk"),
        (key % 9).cast("double").alias("e2e_p95_s"), F.when(key % 13 != 0, (key % 5).cast("double")).alias("cost"),
        F.when(key % 10 == 3, "no accelerator").alias("skipped"),
    )


SHARED["systems"] = """
SELECT *, CASE WHEN skipped IS NULL AND cost <> 0 THEN CASE WHEN e2e_p95_s > 6 THEN 0.0::DOUBLE ELSE qwk / cost END END AS quality_per_dollar FROM (
  SELECT c_name AS system, abs(c_acctbal) / 100.0::DOUBLE AS qwk, CAST(c_custkey % 9 AS DOUBLE) AS e2e_p95_s,
    CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 5 AS DOUBLE) END AS cost, CASE WHEN c_custkey % 10 = 3 THEN 'no accelerator' END AS skipped FROM customer)
"""


@query("SELECT system, round(quality_per_dollar, 6) AS quality_per_dollar FROM systems")
def quality_per_dollar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.quality_per_dollar(systems(spark, d), 6.0).select("system", "quality_per_dollar"))


@query("SELECT system, row_number() OVER (ORDER BY quality_per_dollar DESC, system) AS rank FROM systems WHERE quality_per_dollar > 0")
def rank_systems(spark: SparkSession, d: str) -> DataFrame:
    return M.rank_systems(M.quality_per_dollar(systems(spark, d), 6.0)).select("system", "rank")


@query("SELECT arg_max(system, quality_per_dollar) AS best_quality_per_dollar FROM systems")
def best_system(spark: SparkSession, d: str) -> DataFrame:
    return M.best_system(M.quality_per_dollar(systems(spark, d), 6.0))


@query("""
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM (
  SELECT *, max(best) OVER (ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS faster FROM (SELECT l_quantity, max(l_extendedprice) AS best FROM lineitem GROUP BY l_quantity)) f
JOIN lineitem l USING (l_quantity) WHERE l.l_extendedprice = f.best AND (faster IS NULL OR best > faster)
""")
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Line items no other one beats on price at a smaller quantity."""
    points = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return M.pareto_frontier(points, "l_extendedprice", "l_quantity")


# --- whole jobs --------------------------------------------------------------------------

SHARED["curated"] = f"""
SELECT *, CASE WHEN point < 0.8::DOUBLE THEN 'train' WHEN point < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, ({bucket_sql(21, "source")})::DOUBLE / 10000 AS point FROM (
    SELECT *, row_number() OVER (PARTITION BY quality, lang ORDER BY sha256('21|' || row_id)) AS r, greatest(1, CAST(floor(count(*) OVER () * 0.15::DOUBLE) AS BIGINT)) AS cap
    FROM (SELECT l.row_id, l.lang, l.source, l.text, q.quality, trim(l.text) AS t FROM lines l JOIN labels q ON q.doc_id = l.doc_id) WHERE {SHAPE} IS NULL)
  WHERE r <= cap)
"""


@query("SELECT split, lang, quality, count(*) AS n, count(DISTINCT text) AS texts FROM curated GROUP BY split, lang, quality")
def curated_splits(spark: SparkSession, d: str) -> DataFrame:
    """Labelled lines: shape check, cap per (quality, language), split by source, counts."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = D.lines(spark, d).join(labels, "doc_id").where(shape_fault(F.col("text")).isNull())
    capped = C.cap_strata(rows, ["quality", "lang"], 0.15, 21, uid="row_id")
    split = C.group_split(capped, "source", 21)
    per_text = split.groupBy("split", "lang", "quality", "text").agg(F.count("*").alias("n"))
    return per_text.groupBy("split", "lang", "quality").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))


SHARED["graded"] = """
SELECT * REPLACE (CASE WHEN sound THEN gold_meaning ELSE meaning END AS meaning, CASE WHEN sound THEN gold_feedback ELSE feedback END AS feedback,
  CASE WHEN NOT sound THEN reject_reason WHEN gold_feedback IS NULL THEN 'bad_type' END AS reject_reason)
FROM (SELECT *, (doc_id * 7 + line_no) % 12 <> 5 AS sound FROM verdicts)
"""
SHARED["processed"] = f"""
SELECT v.req_uid, b.grammar, b.naturalness, s.n_edits, s.tags, trim(v.feedback) AS feedback, v.meaning || '|' || v.lang AS stratum, v.text,
  CASE WHEN point < 0.8::DOUBLE THEN 'train' WHEN point < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, ({bucket_sql(42, "sha256(text)")})::DOUBLE / 10000 AS point, row_number() OVER (PARTITION BY meaning, lang ORDER BY sha256('42|' || req_uid)) AS r,
    greatest(1, CAST(floor(count(*) OVER () * 0.15::DOUBLE) AS BIGINT)) AS cap FROM graded WHERE reject_reason IS NULL) v
JOIN bands b ON b.req_uid = v.req_uid JOIN row_stats s ON s.req_uid = v.req_uid WHERE r <= cap
"""


def graded_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts and gradings; of every twelfth the raw one, which is often faulty, else a sound one."""
    sound = (F.col("doc_id") * 7 + F.col("line_no")) % 12 != 5
    m = D.marked(spark, d)
    for c, good in (("correction", "gold"), ("meaning", "gold_meaning"), ("feedback", "gold_feedback")):
        m = m.withColumn(c, F.when(sound, F.col(good)).otherwise(F.col(c)))
    texts = m.select("req_uid", "text", F.col("lang").alias("error_spec"), F.sha2("text", 256).alias("target_norm"))
    return texts, m.select("req_uid", "correction", "meaning", "feedback")


@query("SELECT req_uid, CAST(grammar AS INTEGER) AS grammar, CAST(naturalness AS INTEGER) AS naturalness, n_edits, tags, feedback, split FROM processed")
def process_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The whole build over the raw gradings, grouped by text so that no text crosses."""
    kept, _ = process_flow(*graded_texts(spark, d), 42, "v1", 0.15)
    return kept.select("req_uid", "grammar", "naturalness", "n_edits", F.array_join("tags", ",").alias("tags"), "feedback", "split")


@query("""
SELECT 'input_rows' AS section, 'all' AS key, count(*) AS n FROM graded
UNION ALL SELECT 'clean_rows', 'all', count(*) FROM graded WHERE reject_reason IS NULL
UNION ALL SELECT 'rejected_rows', 'all', count(*) FROM graded WHERE reject_reason IS NOT NULL
UNION ALL SELECT 'reject_reason', reject_reason, count(*) FROM graded WHERE reject_reason IS NOT NULL GROUP BY reject_reason
UNION ALL SELECT 'stratum_before_cap', meaning || '|' || lang, count(*) FROM graded WHERE reject_reason IS NULL GROUP BY meaning || '|' || lang
UNION ALL SELECT 'stratum_after_cap', stratum, count(*) FROM processed GROUP BY stratum
UNION ALL SELECT 'split', split, count(*) FROM processed GROUP BY split
UNION ALL SELECT 'strict_test_rows', 'all', count(*) FROM processed
  WHERE split = 'test' AND text NOT IN (SELECT text FROM processed WHERE split <> 'test')
UNION ALL SELECT 'cross_split_texts', 'all', count(*) FROM (SELECT text FROM processed GROUP BY text HAVING count(DISTINCT split) > 1)
""")
def process_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of the rows of the whole build."""
    return process_with_report(*graded_texts(spark, d), 42, "v1", 0.15)[2]


SHARED["run_rows"] = "SELECT * FROM batch_rows WHERE doc_id % 11 <> 5"
SHARED["run_batches"] = """
SELECT b.doc_id, coalesce(d2, 1.0) AS d2, coalesce(d3, 1.0) AS d3, coalesce(d2, 1.0) < 0.7 AND texts > 0 AS collapsed
FROM (SELECT doc_id, count(*) FILTER (reject_reason IS NULL) AS texts FROM run_rows GROUP BY doc_id) b LEFT JOIN (
  SELECT doc_id, count(DISTINCT gram) FILTER (n = 2) / nullif(count(*) FILTER (n = 2), 0)::DOUBLE AS d2,
    count(DISTINCT gram) FILTER (n = 3) / nullif(count(*) FILTER (n = 3), 0)::DOUBLE AS d3 FROM (
    SELECT doc_id, n, unnest([array_to_string(t[i:i + n - 1], ' ') FOR i IN range(1, len(t) - n + 2)]) AS gram
    FROM (SELECT doc_id, n, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM run_rows, (VALUES (2), (3)) k(n) WHERE reject_reason IS NULL)
    WHERE len(t) >= n) GROUP BY doc_id) g ON g.doc_id = b.doc_id
"""
SHARED["run_refused"] = """
SELECT DISTINCT doc_id, CASE doc_id % 10 WHEN 0 THEN 'missing_spec_id' WHEN 1 THEN 'duplicate_spec_id' ELSE 'unexpected_spec_id' END AS batch_fault
FROM lines WHERE doc_id % 7 <> 3 AND doc_id % 10 <= 2 AND doc_id % 11 <> 5
"""


@query("""
SELECT 'batches' AS section, 'all' AS key, count(*)::DOUBLE AS value FROM run_batches
UNION ALL SELECT 'batches_cached', 'all', count(DISTINCT doc_id) FROM lines WHERE doc_id % 11 = 5
UNION ALL SELECT 'batches_failed', 'all', count(DISTINCT doc_id) FROM lines WHERE doc_id % 11 <> 5 AND (doc_id % 7 = 3 OR doc_id % 10 <= 2)
UNION ALL SELECT 'texts', 'all', count(*) FROM run_rows WHERE reject_reason IS NULL
UNION ALL SELECT 'texts_rejected', 'all', (SELECT count(*) FROM run_rows WHERE reject_reason IS NOT NULL) + (SELECT count(*) FROM run_refused)
UNION ALL SELECT 'low_diversity_batches', 'all', count(*) FILTER (collapsed) FROM run_batches
UNION ALL SELECT 'mean_distinct2', 'all', round(coalesce(avg(d2), 0.0), 4) FROM run_batches
UNION ALL SELECT 'mean_distinct3', 'all', round(coalesce(avg(d3), 0.0), 4) FROM run_batches
UNION ALL SELECT 'reject_reasons', reject_reason, count(*) FROM run_rows WHERE reject_reason IS NOT NULL GROUP BY reject_reason
UNION ALL SELECT 'reject_reasons', batch_fault, count(*) FROM run_refused GROUP BY batch_fault
""")
def generation_report(spark: SparkSession, d: str) -> DataFrame:
    """A resumed run over one batch per document; every eleventh was finished before."""
    specs = batch_specs(spark, d)
    done = specs.where(F.col("batch_uid").cast("long") % 11 == 5)
    return flows.generation_report(batch_responses(spark, d), specs, done)


SHARED["run_labels"] = """
SELECT v.*, s.tags, s.tag_list FROM reply_verdicts v JOIN row_stats s ON s.req_uid = v.req_uid WHERE doc_id % 13 <> 4 AND line_no % 3 <> 0
"""


@query("""
SELECT 'requests' AS section, 'all' AS key, count(*)::DOUBLE AS value FROM lines WHERE doc_id % 13 <> 4
UNION ALL SELECT 'cached', 'all', count(*) FROM lines WHERE doc_id % 13 = 4
UNION ALL SELECT 'failed', 'all', count(*) FROM lines WHERE doc_id % 13 <> 4 AND line_no % 3 = 0
UNION ALL SELECT 'labelled', 'all', count(*) FROM run_labels WHERE outcome IS NULL
UNION ALL SELECT 'rejected', 'all', count(*) FROM run_labels WHERE outcome IS NOT NULL
UNION ALL SELECT 'null_corrections', 'all', count(*) FROM run_labels WHERE outcome IS NULL AND correction IS NULL
UNION ALL SELECT 'validity_rate', 'all', round(coalesce(avg((outcome IS NULL)::INT), 0.0), 4) FROM run_labels
UNION ALL SELECT 'other_tag_share', 'all', round(coalesce(avg((tag = 'other')::INT), 0.0), 4) FROM (SELECT unnest(tag_list) AS tag FROM run_labels WHERE outcome IS NULL)
UNION ALL SELECT 'middle_band_share', 'all', round(coalesce(avg((meaning IN (1, 2, 3))::INT), 0.0), 4) FROM run_labels WHERE outcome IS NULL
UNION ALL SELECT 'reject_reasons', outcome, count(*) FROM run_labels WHERE outcome IS NOT NULL GROUP BY outcome
UNION ALL SELECT 'meaning_counts', meaning::VARCHAR, count(*) FROM run_labels WHERE outcome IS NULL GROUP BY meaning
UNION ALL SELECT 'tag_counts', tag, count(*) FROM (SELECT unnest(tag_list) AS tag FROM run_labels WHERE outcome IS NULL) GROUP BY tag
""")
def label_report(spark: SparkSession, d: str) -> DataFrame:
    """A resumed first pass over all lines; those of every thirteenth document were graded before."""
    texts = D.marked(spark, d).select("req_uid", F.col("source").alias("sense_uid"), "text")
    before = texts.where(F.substring_index("req_uid", ":", 1).cast("long") % 13 == 4)
    return flows.label_report(texts, replies(spark, d), before)
