"""Registered queries: scores, calibration, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.arrays import with_columns_once
from marginalia.operators import calibration as B
from marginalia.operators import gates as X
from marginalia.operators import requests as R
from marginalia.operators import scoring as S
from marginalia.operators import spans as E
from marginalia.operators import tally as T
from marginalia.operators.grading import apply_corrections, check_rows
from marginalia.plans import derive as D
from marginalia.plans.curation import prediction_rows, row_stats
from marginalia.plans.flows import score_report as score_flow
from marginalia.plans.flows import unpivot
from marginalia.plans.markup import gold_penalties
from marginalia.plans.registry import SHARED, query, spread, table
from marginalia.schemas import CONFUSABLE_PAIRS, literal_rows


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    return df.select([F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return D.side_edits(spark, d, "pred"), D.side_edits(spark, d, "gold")


# --- edit sets ---------------------------------------------------------------------------

SHARED["edit_sides"] = """
SELECT req_uid, "start", "end", tag, max(p) AS p, max(g) AS g FROM (
  SELECT req_uid, "start", "end", tag, 1 AS p, 0 AS g FROM pred_pairs UNION ALL SELECT req_uid, "start", "end", tag, 0, 1 FROM gold_pairs)
GROUP BY req_uid, "start", "end", tag
"""
SHARED["span_sides"] = """
SELECT req_uid, "start", "end", max(p) AS p, max(g) AS g, min(tag) FILTER (p = 1) AS pred_tag, max(tag) FILTER (g = 1) AS gold_tag
FROM edit_sides GROUP BY req_uid, "start", "end"
"""
SHARED["row_f1"] = """
SELECT m.req_uid, CASE WHEN coalesce(np + ng, 0) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * nb / (np + ng) END AS f1, coalesce(np = nb AND ng = nb, true) AS same
FROM marked m LEFT JOIN (SELECT req_uid, sum(p) AS np, sum(g) AS ng, sum(p * g) AS nb FROM edit_sides GROUP BY req_uid) s ON s.req_uid = m.req_uid
"""


@query("""SELECT req_uid, "start", "end", tag, p = 1 AS in_pred, g = 1 AS in_gold FROM edit_sides""")
def match_edits(spark: SparkSession, d: str) -> DataFrame:
    return E.match_edits(*edits(spark, d))


@query("""
SELECT req_uid, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(g) AS BIGINT) AS n_gold, CAST(sum(p * g) AS BIGINT) AS n_both, min(p * g) = 1 AS equal_sets
FROM edit_sides GROUP BY req_uid
""")
def edit_set_ops(spark: SparkSession, d: str) -> DataFrame:
    return E.edit_set_ops(*edits(spark, d))


@query("SELECT round(avg(f1), 6) AS edit_f1 FROM row_f1")
def edit_f1_macro(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.edit_f1_macro(D.paired_edits(spark, d)))


SHARED["score_sums"] = """
SELECT (SELECT count(*) FROM marked) AS n, (SELECT count(*) FILTER (same) FROM row_f1) AS same,
  (SELECT sum(p) FROM edit_sides)::DOUBLE AS np, (SELECT sum(g) FROM edit_sides)::DOUBLE AS ng, (SELECT sum(p * g) FROM edit_sides)::DOUBLE AS nb,
  (SELECT sum(p * g) FROM span_sides)::DOUBLE AS ns,
  (SELECT count(*) FROM span_sides s JOIN weights a ON a.tag = s.gold_tag JOIN weights b ON b.tag = s.pred_tag WHERE p * g = 1 AND a.weight <> b.weight) AS nx
"""


@query("""
SELECT round(nb / np, 6) AS span_tag_precision, round(nb / ng, 6) AS span_tag_recall, round(2 * nb / (np + ng), 6) AS span_tag_f1,
  round(ns / np, 6) AS span_only_precision, round(ns / ng, 6) AS span_only_recall, round(2 * ns / (np + ng), 6) AS span_only_f1,
  round((ns - nb) / ns, 6) AS tag_error_rate, round(nx / ns, 6) AS cross_tier_confusion_rate, nx AS cross_tier_confusions,
  round(same / n, 6) AS exact_row_rate, CAST(np AS BIGINT) AS predicted_edits, CAST(ng AS BIGINT) AS gold_edits FROM score_sums
""")
def correction_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.correction_scores(D.paired_edits(spark, d)))


@query("SELECT gold_tag, pred_tag, count(*) AS n FROM span_sides WHERE p * g = 1 GROUP BY gold_tag, pred_tag")
def tag_confusion(spark: SparkSession, d: str) -> DataFrame:
    return S.tag_confusion(D.paired_edits(spark, d))


@query("SELECT tag, count(*) AS n FROM gold_pairs GROUP BY tag")
def tag_distribution(spark: SparkSession, d: str) -> DataFrame:
    return T.tag_distribution(edits(spark, d)[1])


@query("""
SELECT tag, CAST(sum(p) AS BIGINT) AS pred_n, CAST(sum(g) AS BIGINT) AS gold_n, round(sum(p) / (SELECT count(*) FROM pred_pairs), 6) AS pred_rate,
  round(sum(g) / (SELECT count(*) FROM gold_pairs), 6) AS gold_rate
FROM (SELECT tag, 1 AS p, 0 AS g FROM pred_pairs UNION ALL SELECT tag, 0, 1 FROM gold_pairs) GROUP BY tag
""")
def taxonomy_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.taxonomy_report(*edits(spark, d)))


@query("""
SELECT 'row' AS per, CAST(sum(len(tag_list)) AS BIGINT) AS tags, round(sum(list_contains(tag_list, 'other')::INT) / sum(len(tag_list)), 6) AS other_tag_share FROM row_stats
UNION ALL SELECT 'edit', count(*), round(count(*) FILTER (tag = 'other') / count(*), 6) FROM gold_pairs
""")
def other_tag_share(spark: SparkSession, d: str) -> DataFrame:
    rows = row_stats(spark, d)
    both = [T.other_tag_share(rows, per).withColumn("per", F.lit(per)) for per in ("row", "edit")]
    return rounded(both[0].unionByName(both[1]))


TAG_MIX = """
SELECT tag, round(a, 4) AS share_a, round(b, 4) AS share_b, CASE WHEN b > 0 THEN round(a / b, 6) END AS ratio FROM (
  SELECT tag, sum(en) / sum(sum(en)) OVER () AS a, sum(1 - en) / sum(sum(1 - en)) OVER () AS b
  FROM (SELECT unnest(tag_list) AS tag, (lang = 'en')::INT AS en FROM row_stats) GROUP BY tag)
"""
SHARED["tag_mix"] = TAG_MIX


@query("SELECT * FROM tag_mix")
def tag_mix_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = row_stats(spark, d)
    en = F.col("lang") == "en"
    return rounded(S.tag_mix_compare(rows.where(en), rows.where(~en)))


@query("""
SELECT tag, share_a, share_b, CASE WHEN share_a / share_b >= 1.02 THEN 'over' ELSE 'under' END AS skew FROM tag_mix
WHERE share_a > 0 AND share_b > 0 AND (share_a / share_b >= 1.02 OR share_a / share_b <= 0.98)
""")
def tag_skew_flags(spark: SparkSession, d: str) -> DataFrame:
    return S.tag_skew_flags(tag_mix_compare(spark, d), 1.02, 0.98)


@query("""
SELECT tag, 'unknown_tag' AS problem, count(*) AS n FROM (
  SELECT CASE WHEN tag = 'word' THEN 'vocab' ELSE tag END AS tag FROM gold_pairs) WHERE tag = 'vocab' GROUP BY tag
UNION ALL SELECT tag, 'no_weight', 0 FROM weights WHERE tag = 'word' OR tag NOT IN (SELECT tag FROM gold_pairs)
""")
def tag_closure(spark: SparkSession, d: str) -> DataFrame:
    """The edits with one tag renamed, against the weights of the tags still in use."""
    gold = edits(spark, d)[1]
    renamed = gold.withColumn("tag", F.when(F.col("tag") == "word", "vocab").otherwise(F.col("tag")))
    used = renamed.groupBy("tag").agg(F.lit(1).alias("weight"))
    return E.tag_closure(renamed, used)


@query("""
SELECT round(1.25 * fp * fr / (0.25 * fp + fr), 6) AS full_edit_f05, round(1.25 * sp * sr / (0.25 * sp + sr), 6) AS span_f05,
  round(clean_hit / clean, 6) AS clean_accuracy, round(1 - bad / n, 6) AS valid_output_rate
FROM (SELECT fb / fpn AS fp, fb / fgn AS fr, sb / spn AS sp, sb / sgn AS sr, * FROM (
  SELECT (SELECT count(*) FROM span_full WHERE p = 1)::DOUBLE AS fpn, (SELECT count(*) FROM span_full WHERE g = 1)::DOUBLE AS fgn,
    (SELECT count(*) FROM span_full WHERE p = 1 AND g = 1)::DOUBLE AS fb,
    (SELECT count(*) FROM span_only WHERE p = 1)::DOUBLE AS spn, (SELECT count(*) FROM span_only WHERE g = 1)::DOUBLE AS sgn,
    (SELECT count(*) FROM span_only WHERE p = 1 AND g = 1)::DOUBLE AS sb, n, bad, clean, clean_hit FROM (
    SELECT count(*) AS n, count(*) FILTER (doc_id % 6 = 1) AS bad, count(*) FILTER (gold IS NULL) AS clean,
      count(*) FILTER (gold IS NULL AND np = 0 AND doc_id % 6 <> 1 AND pred IS NOT NULL) AS clean_hit
    FROM (SELECT m.doc_id, m.gold, m.pred, coalesce(p.n, 0) AS np FROM marked m
      LEFT JOIN (SELECT req_uid, count(*) AS n FROM pred_pairs GROUP BY req_uid) p ON p.req_uid = m.req_uid))))
""")
def span_f05_scores(spark: SparkSession, d: str) -> DataFrame:
    pred = D.marked(spark, d).select("req_uid", "doc_id", "text", "gold", F.col("pred").alias("correction"))
    lines = E.edits_to_spans(pred)
    broken = F.when(F.col("doc_id") % 6 == 1, "\n0 1 sp x").otherwise("")
    rows = lines.select(
        "text", F.concat("span_lines", broken).alias("prediction"), F.col("gold").alias("reference")
    )
    return rounded(S.span_f05_scores(rows))


SHARED["pred_full"] = """
SELECT req_uid, a, b, tag, replacement FROM pred_spans UNION ALL SELECT req_uid, 0, 1, 'sp', 'x' FROM marked WHERE doc_id % 6 = 1
"""
SHARED["span_full"] = """
SELECT req_uid, a, b, tag, replacement, max(p) AS p, max(g) AS g FROM (SELECT *, 1 AS p, 0 AS g FROM pred_full
  UNION ALL SELECT req_uid, a, b, tag, replacement, 0, 1 FROM gold_spans) GROUP BY req_uid, a, b, tag, replacement
"""
SHARED["span_only"] = "SELECT req_uid, a, b, max(p) AS p, max(g) AS g FROM span_full GROUP BY req_uid, a, b"


@query()
def rewrite_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = apply_corrections(D.marked(spark, d), "pred")
    return rounded(
        S.rewrite_scores(
            rows.select("text", F.col("corrected_text").alias("prediction"), F.col("gold").alias("reference"))
        )
    )


# --- bands, formats, feedback ------------------------------------------------------------


def band_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag"),
        (F.col("l_linenumber") % 6).alias("predicted"),
        (F.col("l_suppkey") % 5).cast("int").alias("gold"),
    )


SHARED["band_pairs"] = """
SELECT l_returnflag, l_linenumber % 6 AS predicted, CAST(l_suppkey % 5 AS INTEGER) AS gold FROM lineitem
"""
KAPPA = """
SELECT {key} {sep} CAST(sum(o.n) AS BIGINT) AS n, round(1 - sum(o.n * (o.a - o.b) ** 2) / any_value(e.w), 6) AS qwk
FROM (SELECT {key} {sep} predicted AS a, gold AS b, count(*)::DOUBLE AS n FROM band_pairs WHERE predicted <= 4 GROUP BY ALL) o
JOIN (SELECT {key} {sep} sum(r.n * c.n * (r.a - c.b) ** 2 / t.n) AS w
  FROM (SELECT {key} {sep} predicted AS a, count(*)::DOUBLE AS n FROM band_pairs WHERE predicted <= 4 GROUP BY ALL) r
  JOIN (SELECT {key} {sep} gold AS b, count(*)::DOUBLE AS n FROM band_pairs WHERE predicted <= 4 GROUP BY ALL) c {using}
  JOIN (SELECT {key} {sep} count(*)::DOUBLE AS n FROM band_pairs WHERE predicted <= 4 {group}) t {using} {group}) e {using} {group}
"""


@query(KAPPA.format(key="l_returnflag", sep=",", using="USING (l_returnflag)", group="GROUP BY l_returnflag"))
def quadratic_weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.quadratic_weighted_kappa(band_pairs(spark, d), "predicted", "gold", ["l_returnflag"]))


@query(f"""
SELECT k.qwk, round(avg((predicted = gold)::INT), 6) AS exact, round(avg((abs(predicted - gold) <= 1)::INT), 6) AS within_one,
  round(avg(abs(predicted - gold)), 6) AS mae FROM band_pairs, ({KAPPA.format(key="", sep="", using="ON true", group="")}) k WHERE predicted <= 4 GROUP BY k.qwk
""")
def meaning_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.meaning_metrics(band_pairs(spark, d)))


@query("""
SELECT b.band, coalesce(n, 0) AS n, round(exact, 6) AS exact, round(within_one, 6) AS within_one
FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS band) b LEFT JOIN (SELECT gold, count(*) AS n, avg((predicted = gold)::INT) AS exact,
  avg((abs(predicted - gold) <= 1)::INT) AS within_one FROM band_pairs WHERE predicted <= 4 GROUP BY gold) s ON s.gold = b.band
""")
def per_band_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.per_band_metrics(band_pairs(spark, d)))


@query("""
SELECT b.band, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM labels), 6) AS share
FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS band) b LEFT JOIN (SELECT quality, count(*) AS n FROM labels GROUP BY quality) s ON s.quality = b.band
""")
def band_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.band_distribution(table(spark, d, "labels"), "quality"))


@query("SELECT round(avg((gold_meaning BETWEEN 1 AND 3)::INT), 6) AS middle_band_share FROM marked")
def middle_band_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.middle_band_share(D.marked(spark, d), "gold_meaning"))


@query("""
SELECT round(avg(answered::INT), 6) AS json_parse_rate, round(avg((answered AND reject_reason IS NULL)::INT), 6) AS validity_rate,
  round(avg((answered AND (correction IS NULL OR (doc_id + line_no) % 17 NOT IN (1, 2, 3, 4)))::INT), 6) AS strip_identity_rate, round(avg(retries), 6) AS retries_per_row
FROM (SELECT *, (doc_id + line_no) % 14 <> 0 AS answered, (doc_id + line_no) % 3 AS retries FROM verdicts)
""")
def format_metrics(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id") + F.col("line_no")
    rows = D.marked(spark, d).select(
        "text", (key % 3).cast("int").alias("retries"),
        F.when(key % 14 != 0, F.struct("correction", "meaning", "feedback")).alias("prediction"),
    )
    return rounded(S.format_metrics(rows))


@query("""
SELECT count(*) AS rows, count(*) FILTER (reject_reason IS NULL) AS valid, round(avg((reject_reason IS NULL)::INT), 6) AS validity_rate FROM verdicts
""")
def validity_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.validity_rate(check_rows(D.marked(spark, d))))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation turn as the prediction for the turn after it."""
    c = spread(table(spark, d, "conversations"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("pred_feedback"))
    return c.select("conv_id", "turn", F.col("text").alias("gold_feedback")).join(before, ["conv_id", "turn"])


SHARED["turn_pairs"] = """
SELECT a.conv_id || ':' || a.turn AS id, b.text AS p, a.text AS g FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn
"""
SHARED["char_grams"] = """
SELECT id, n, side, gram, count(*) AS c FROM (
  SELECT id, n, side, unnest([array_to_string(ch[i:i + n - 1], '') FOR i IN range(1, len(ch) - n + 2)]) AS gram
  FROM (SELECT id, 'p' AS side, string_split(p, '') AS ch FROM turn_pairs UNION ALL SELECT id, 'g', string_split(g, '') FROM turn_pairs),
       (SELECT unnest(range(1, 7)) AS n) WHERE len(ch) >= n) GROUP BY id, n, side, gram
"""


SHARED["chrf_score"] = """
SELECT round(avg(coalesce(c, 0.0)), 6) AS chrf, count(*) AS n FROM turn_pairs t LEFT JOIN (
  SELECT id, avg(2.0::DOUBLE * nb / (np + ng)) AS c FROM (
    SELECT id, n, sum(shared) AS nb, sum(p) AS np, sum(g) AS ng FROM (
      SELECT id, n, gram, least(coalesce(sum(c) FILTER (side = 'p'), 0), coalesce(sum(c) FILTER (side = 'g'), 0)) AS shared,
        coalesce(sum(c) FILTER (side = 'p'), 0) AS p, coalesce(sum(c) FILTER (side = 'g'), 0) AS g FROM char_grams GROUP BY id, n, gram) GROUP BY id, n)
  WHERE np > 0 AND ng > 0 GROUP BY id) s ON s.id = t.id
"""


@query("SELECT chrf, n FROM chrf_score")
def feedback_chrf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.feedback_chrf(turns(spark, d)))


@query("""
SELECT n, consistent, CASE WHEN consistent > 0 THEN round(wins / consistent, 6) ELSE 0.0::DOUBLE END AS judge_win_rate,
  round(1 - consistent / n, 6) AS judge_discard_rate, 'weak' AS reliability FROM (
  SELECT count(*) AS n, count(*) FILTER (f = b) AS consistent, count(*) FILTER (f = b AND f) AS wins FROM (
    SELECT conv_id, turn // 2 AS pair, bool_or(choice) FILTER (turn % 2 = 0) AS f, bool_or(choice) FILTER (turn % 2 = 1) AS b FROM (
      SELECT *, CASE WHEN letter <> '' THEN (letter = 'A') = (turn % 2 = 0) END AS choice FROM (
        SELECT *, regexp_extract(upper(text), '[AB]') AS letter FROM conversations)) GROUP BY ALL))
""")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 2)).alias("req_uid"),
        F.when(F.col("turn") % 2 == 0, "forward").otherwise("backward").alias("order"),
        F.col("text").alias("reply"),
    )
    return rounded(S.judge_summary(rows))


@query("""
SELECT req_uid, n * 10.0::DOUBLE + u * 2.0::DOUBLE + least(n_words, 40) * 0.1::DOUBLE AS score FROM (
  SELECT m.req_uid, c.n_words, coalesce(e.n, 0) AS n, coalesce(e.u, 0) AS u FROM marked m JOIN word_counts c ON c.req_uid = m.req_uid
  LEFT JOIN (SELECT req_uid, count(*) AS n, count(DISTINCT tag) AS u FROM gold_pairs GROUP BY req_uid) e ON e.req_uid = m.req_uid
  WHERE m.gold IS NOT NULL AND trim(m.text) <> trim(m.gold)) ORDER BY score DESC, req_uid LIMIT 16
""")
def hardest_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = D.marked(spark, d).select("req_uid", "text", F.col("gold").alias("correction"))
    return rounded(S.hardest_rows(rows).select("req_uid", "score"))


@query("""
SELECT req_uid, text, gold_correction, pred_correction AS predicted_correction, gold_meaning, pred_meaning AS predicted_meaning, answered AS valid, retries
FROM predictions ORDER BY req_uid LIMIT 200
""")
def qualitative_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.qualitative_rows(prediction_rows(spark, d)).drop("gold_feedback", "predicted_feedback")


@query("""
SELECT count(*) AS rows, count(*) FILTER (reject_reason IS NOT NULL) AS invalid, (SELECT CAST(count(DISTINCT tag) AS INTEGER) FROM gold_pairs) AS tags,
  count(*) FILTER (correction IS NULL) AS unparseable, count(*) FILTER (correction IS NOT NULL AND (doc_id + line_no) % 17 NOT IN (1, 2, 3) AND s.n_edits = 0) AS verbatim,
  count(*) FILTER (contains(target, ' ')) AS multiword, 'invalid' AS failures FROM verdicts v JOIN row_stats s ON s.req_uid = v.req_uid
""")
def fixture_coverage(spark: SparkSession, d: str) -> DataFrame:
    return S.fixture_coverage(D.marked(spark, d))


# --- calibration -------------------------------------------------------------------------


def confident(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_id"),
        F.col("l_discount").alias("confidence"),
        (F.col("l_linenumber") % 5 == F.col("l_suppkey") % 5).alias("right"),
    )


SHARED["confident"] = """
SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || strftime(l_shipdate, '%Y%m%d') AS row_id, l_discount AS confidence,
  l_linenumber % 5 = l_suppkey % 5 AS "right" FROM lineitem
"""


@query("""
SELECT row_id, r AS rank, CAST(bin AS INTEGER) AS bin FROM (SELECT *, CAST((
  (r >= round_even(n * 0.1::DOUBLE, 0))::INT + (r >= round_even(n * 2 / 10::DOUBLE, 0))::INT + (r >= round_even(n * 3 / 10::DOUBLE, 0))::INT +
  (r >= round_even(n * 4 / 10::DOUBLE, 0))::INT + (r >= round_even(n * 5 / 10::DOUBLE, 0))::INT + (r >= round_even(n * 6 / 10::DOUBLE, 0))::INT +
  (r >= round_even(n * 7 / 10::DOUBLE, 0))::INT + (r >= round_even(n * 8 / 10::DOUBLE, 0))::INT + (r >= round_even(n * 9 / 10::DOUBLE, 0))::INT) AS INTEGER) AS bin
  FROM (SELECT *, row_number() OVER (ORDER BY confidence, row_id) - 1 AS r, count(*) OVER () AS n FROM confident))
""")
def equal_mass_rank(spark: SparkSession, d: str) -> DataFrame:
    return B.equal_mass_rank(confident(spark, d), "confidence", 10).select("row_id", "rank", "bin")


def bins(spark: SparkSession, d: str) -> DataFrame:
    return B.reliability_bins(confident(spark, d), "confidence", "right")


SHARED["rel_bins"] = """
SELECT bin, min(confidence) AS lower, max(confidence) AS upper, count(*) AS count, avg(confidence) AS mean_confidence, avg("right"::INT) AS accuracy FROM (
  SELECT *, len(list_filter(range(1, 10), lambda i: r >= round_even(n * i / 10::DOUBLE, 0)))::INTEGER AS bin FROM (
    SELECT *, row_number() OVER (ORDER BY confidence, row_id) - 1 AS r, count(*) OVER () AS n FROM confident)) GROUP BY bin
"""


@query("""
SELECT bin, lower, upper, count, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM rel_bins
""")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bins(spark, d))


@query("""
SELECT round(sum(count * abs(mean_confidence - accuracy)) / sum(count), 5) AS ece, CAST(sum(count) AS BIGINT) AS n,
  round(sum(count * mean_confidence) / sum(count), 5) AS mean_confidence, round(sum(count * accuracy) / sum(count), 5) AS accuracy FROM rel_bins
""")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.ece(bins(spark, d)), 5)


SHARED["quintiles"] = """
SELECT CAST(i AS INTEGER) AS cut, v[CAST(round_even(i / 5::DOUBLE * (len(v) - 1), 0) AS INTEGER) + 1] AS threshold
FROM (SELECT list(penalty ORDER BY penalty) AS v FROM penalties), (SELECT unnest(range(1, 5)) AS i)
"""


@query("SELECT cut, round(threshold, 6) AS threshold FROM quintiles")
def uniform_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.uniform_thresholds(gold_penalties(spark, d)))


@query("""
SELECT count(*) AS cuts, count(DISTINCT threshold) AS distinct_cuts, count(*) = count(DISTINCT threshold) AS passed,
  (SELECT round(avg((penalty = 0)::INT), 6) FROM penalties) AS zero_share FROM quintiles
""")
def threshold_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = gold_penalties(spark, d)
    return rounded(B.threshold_guard(B.uniform_thresholds(rows), rows))


CUTS = [0.05, 0.3, 0.8, 1.4]


@query("""
SELECT grp, CAST(4 - (penalty > 0.05)::INT - (penalty > 0.3)::INT - (penalty > 0.8)::INT - (penalty > 1.4)::INT AS INTEGER) AS band, count(*) AS n
FROM penalties GROUP BY ALL
""")
def calibrated_distribution(spark: SparkSession, d: str) -> DataFrame:
    return B.calibrated_distribution(gold_penalties(spark, d), CUTS)


@query("""
SELECT CAST(5 - b AS INTEGER) AS cut, round((m + below) / 2, 6) AS threshold FROM (
  SELECT gold_meaning AS b, avg(penalty) AS m, lag(avg(penalty)) OVER (ORDER BY gold_meaning) AS below
  FROM penalties p JOIN marked k ON k.req_uid = p.req_uid GROUP BY gold_meaning) WHERE b > 0
""")
def fit_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.fit_thresholds(gold_penalties(spark, d), "penalty", "gold_meaning"))


@query("""
SELECT a, b, x.weight AS weight_a, y.weight AS weight_b, x.weight = y.weight AS passed FROM (VALUES ('word', 'coll'), ('prep', 'part')) p(a, b)
JOIN tag_weights x ON x.tag = a JOIN tag_weights y ON y.tag = b
""")
def confusable_weight_guard(spark: SparkSession, d: str) -> DataFrame:
    """Weights taken from how often each tag occurs."""
    counts = T.tag_distribution(edits(spark, d)[1])
    weights = counts.select("tag", (F.col("n") % 3 + 1).cast("int").alias("weight"))
    return B.confusable_weight_guard(weights, literal_rows(spark, "a string, b string", CONFUSABLE_PAIRS))


SHARED["tag_weights"] = "SELECT tag, CAST(count(*) % 3 + 1 AS INTEGER) AS weight FROM gold_pairs GROUP BY tag"

# --- gates and reports -------------------------------------------------------------------


def passes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = D.marked(spark, d)
    first = m.select("req_uid", F.col("gold_meaning").alias("meaning"), F.col("gold").alias("correction"))
    again = m.select(
        "req_uid", F.when(F.col("line_no") % 4 == 0, F.col("pred_meaning")).otherwise(F.col("gold_meaning")).alias("meaning"), "pred",
    )
    # Once, so that the filter does not build the prediction a second time.
    again = with_columns_once(again, correction=F.col("pred")).where(F.col("correction").isNotNull())
    return first, again.drop("pred")


SHARED["pass_pairs"] = """
SELECT req_uid, gold_meaning AS a, CASE WHEN line_no % 4 = 0 THEN pred_meaning ELSE gold_meaning END AS b FROM marked WHERE pred IS NOT NULL
"""
SHARED["consistency"] = """
SELECT (SELECT 1 - sum((a - b) ** 2) / (sum(a * a) + sum(b * b) - 2.0::DOUBLE * sum(a) * sum(b) / count(*)) FROM pass_pairs) AS qwk,
  (SELECT avg(f1) FROM row_f1 f JOIN pass_pairs p ON p.req_uid = f.req_uid) AS edit_f1, (SELECT count(*) FROM pass_pairs) AS pairs
"""


@query("SELECT round(qwk, 6) AS qwk, round(edit_f1, 6) AS edit_f1, pairs FROM consistency")
def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.self_consistency(*passes(spark, d)))


def gate_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = D.marked(spark, d)
    shares = T.band_distribution(m, "gold_meaning")
    parts = [
        X.self_consistency(*passes(spark, d)).select(
            F.col("qwk").alias("self_consistency_qwk"), F.col("edit_f1").alias("self_consistency_edit_f1")
        ),
        shares.agg(
            F.sum(F.when(F.col("band").isin(1, 2, 3), F.col("share")).otherwise(0.0)).alias("middle_band_share"),
            F.count_if(F.col("n") == 0).alias("empty_bands"),
        ),
        T.validity_rate(check_rows(m)).select(F.col("validity_rate").alias("format_validity")),
        R.batch_diversity(m, "source", "text").agg(F.avg("distinct2").alias("mean_distinct2")),
        T.other_tag_share(row_stats(spark, d)).select("other_tag_share"),
        S.quadratic_weighted_kappa(m, "gold_meaning", "pred_meaning").select(F.col("qwk").alias("batch_single_qwk")),
    ]
    stacked = unpivot(parts[0], "pilot")
    for p in parts[1:]:
        stacked = stacked.unionByName(unpivot(p, "pilot"))
    return stacked.select("metric", "value")


SHARED["gate_rows"] = """
SELECT name, round(value, 4) AS value, threshold::DOUBLE AS threshold, passed, blocking FROM (
  SELECT 'G1_self_consistency' AS name, qwk AS value, 0.7 AS threshold, qwk >= 0.7 AND edit_f1 >= 0.6 AS passed, true AS blocking FROM consistency
  UNION ALL SELECT 'G2_band_coverage', v, 0.4, v >= 0.4 AND bands = 5, true FROM (
    SELECT avg((gold_meaning BETWEEN 1 AND 3)::INT) AS v, count(DISTINCT gold_meaning) AS bands FROM marked)
  UNION ALL SELECT 'G3_format_validity', v, 0.9, v > 0.9, false FROM (SELECT avg((reject_reason IS NULL)::INT) AS v FROM verdicts)
  UNION ALL SELECT 'G4_batch_diversity', v, 0.7, v > 0.7, false FROM (SELECT avg(d2) AS v FROM (
    SELECT source, count(DISTINCT gram) / count(*)::DOUBLE AS d2 FROM grams WHERE n = 2 GROUP BY source))
  UNION ALL SELECT 'G5_other_tag_share', v, 0.05, v < 0.05, false FROM (
    SELECT sum(list_contains(tag_list, 'other')::INT) / sum(len(tag_list)) AS v FROM row_stats)
  UNION ALL SELECT 'G6_batch_single_parity', v, 0.8, v >= 0.8, false FROM (
    SELECT 1 - sum((gold_meaning - pred_meaning) ** 2) / (sum(gold_meaning ** 2) + sum(pred_meaning ** 2)
      - 2.0::DOUBLE * sum(gold_meaning) * sum(pred_meaning) / count(*)) AS v FROM marked))
"""


@query("SELECT name, value, threshold, passed, blocking FROM gate_rows")
def pilot_gate(spark: SparkSession, d: str) -> DataFrame:
    return X.pilot_gate(gate_metrics(spark, d))


@query("SELECT bool_and(passed) AS passed, bool_and(passed OR NOT blocking) AS blocking_passed FROM gate_rows")
def pilot_verdict(spark: SparkSession, d: str) -> DataFrame:
    return X.pilot_verdict(X.pilot_gate(gate_metrics(spark, d)))


@query("""
SELECT count(*) AS rows, count(reject_reason) AS rejected, round(count(reject_reason) / count(*), 6) AS reject_rate, count(reject_reason) / count(*) <= 0.10 AS passed FROM verdicts
""")
def reject_rate_gate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.reject_rate_gate(check_rows(D.marked(spark, d))))


SHARED["answered_sums"] = """
SELECT sum(n) AS n, sum((a - b) ** 2 * n) AS seen, sum(a * a * n) + sum(b * b * n) - 2.0::DOUBLE * sum(a * n) * sum(b * n) / sum(n) AS expected,
  avg((a = b)::INT) AS exact FROM (SELECT pred_meaning AS a, gold_meaning AS b, 1 AS n FROM predictions WHERE answered)
"""


@query("""
SELECT 'meaning' AS grp, 'qwk' AS metric, round(q, 6) AS value, 'strong' AS reliability, round(c, 6) AS ceiling, CASE WHEN c > 0 THEN round(q / c, 6) END AS fraction
FROM (SELECT 1 - seen / expected AS q FROM answered_sums), (SELECT qwk AS c FROM consistency)
UNION ALL SELECT 'meaning', 'exact', round(exact, 6), 'strong', NULL, NULL FROM answered_sums
UNION ALL SELECT 'feedback', 'chrf', chrf, 'weak', NULL, NULL FROM chrf_score
""")
def ceiling_report(spark: SparkSession, d: str) -> DataFrame:
    rows = prediction_rows(spark, d).select(F.col("prediction.meaning").alias("predicted"), F.col("gold.meaning").alias("gold"))
    found = unpivot(S.meaning_metrics(rows).select("qwk", "exact"), "meaning")
    weak = S.feedback_chrf(turns(spark, d)).select("chrf")
    bars = X.self_consistency(*passes(spark, d)).select(F.lit("meaning_qwk").alias("metric"), F.col("qwk").alias("value"))
    return rounded(X.ceiling_report(found.unionByName(unpivot(weak, "feedback")), bars))


@query("""
SELECT lang AS grp, 'exact' AS metric, problem FROM (SELECT DISTINCT lang FROM marked),
  (VALUES ('de', 'no reliability tag'), ('fr', 'missing split'), ('de', 'missing lineage')) p(l, problem) WHERE lang = l
""")
def report_contract(spark: SparkSession, d: str) -> DataFrame:
    by_lang = D.marked(spark, d).groupBy(F.col("lang").alias("grp")).agg(
        F.avg((F.col("gold_meaning") == F.col("pred_meaning")).cast("double")).alias("value"), F.count("*").alias("rows")
    )
    report = by_lang.select(
        "grp", F.lit("exact").alias("metric"), "value", "rows", F.lit("dev").alias("stage"),
        F.when(F.col("grp") != "fr", "test").alias("split"), F.when(F.col("grp") != "de", "abc").alias("lineage"),
        F.when(F.col("grp") != "de", "strong").alias("reliability"), F.lit(1.0).alias("ceiling"),
    )
    return X.report_contract(report)


@query()
def score_report(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of the prediction table in one report."""
    bars = X.self_consistency(*passes(spark, d))
    ceilings = unpivot(bars.select(F.col("qwk").alias("meaning_qwk"), F.col("edit_f1").alias("correction_edit_f1")), "c")
    return rounded(score_flow(prediction_rows(spark, d), ceilings.select("metric", "value")))
