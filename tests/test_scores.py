"""Scores with values worked out by hand."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.arrays import with_columns_once
from marginalia.functions.markup import parse_markup
from marginalia.operators import calibration as B
from marginalia.operators import scoring as S
from marginalia.plans.flows import score_report
from marginalia.schemas import BandConfig

GOOD = "The meaning is clear."
# Eight sentences: a full hit, a wrong tag of equal weight, one of another weight, a clean
# one, a missed edit, a hit with a spurious edit, one beyond repair, and a band off by one.
ROWS = [
    ("We walk there yesterday.", "We [walk>walked:tense] there yesterday.", 4, "We [walk>walked:tense] there yesterday.", 4, 0.95),
    ("It rain a lot.", "It [rain>rains:agr] a lot.", 4, "It [rain>rains:tense] a lot.", 4, 0.9),
    ("My freind left.", "My [freind>friend:sp] left.", 4, "My [freind>friend:order] left.", 3, 0.55),
    ("All is fine.", "All is fine.", 4, "All is fine.", 4, 0.99),
    ("Two dog ran.", "Two [dog>dogs:num] ran.", 4, "Two dog ran.", 4, 0.7),
    ("That is my sister car.", "That is my [sister>sister's:poss] car.", 4, "That is [my>the:art] [sister>sister's:poss] car.", 2, 0.4),
    ("Cloud the eats of.", None, 0, None, 0, 0.85),
    ("He think and wait.", "He think and [wait>waits:agr].", 1, "He think and [wait>waits:agr].", 2, 0.3),
]


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [
        (f"p{i}", t, "sister car", "d", "noun", (g, gm, GOOD), (p, pm, GOOD), c, 0, "")
        for i, (t, g, gm, p, pm, c) in enumerate(ROWS)
    ]
    from marginalia.schemas import PREDICTIONS

    return spark.createDataFrame(rows, PREDICTIONS)


@pytest.fixture(scope="module")
def paired(predictions):
    return with_columns_once(
        predictions,
        gold_edits=parse_markup(F.col("gold.correction"))["edits"],
        pred_edits=parse_markup(F.col("prediction.correction"))["edits"],
    )


def test_correction_scores(paired):
    got = S.correction_scores(paired).first()
    assert got["span_tag_precision"] == got["span_tag_recall"] == got["span_tag_f1"] == pytest.approx(0.5)
    assert got["span_only_f1"] == pytest.approx(5 / 6)
    assert got["tag_error_rate"] == pytest.approx(0.4)
    assert (got["cross_tier_confusions"], got["cross_tier_confusion_rate"]) == (1, pytest.approx(0.2))
    assert got["exact_row_rate"] == pytest.approx(4 / 8)


def test_meaning_metrics(predictions):
    flat = predictions.select(F.col("prediction.meaning").alias("predicted"), F.col("gold.meaning").alias("gold"))
    got = S.meaning_metrics(flat).first()
    assert (got["exact"], got["within_one"], got["mae"]) == (5 / 8, 7 / 8, 0.5)
    bands = {r["band"]: (r["n"], r["exact"]) for r in S.per_band_metrics(flat).collect()}
    assert bands == {0: (1, 1.0), 1: (1, 0.0), 2: (0, None), 3: (0, None), 4: (6, 4 / 6)}


def test_report(spark, predictions):
    ceilings = spark.createDataFrame([("meaning_qwk", 0.8), ("correction_edit_f1", 0.5)], "metric string, value double")
    rows = {(r["grp"], r["metric"]): r for r in score_report(predictions, ceilings, 4).collect()}
    assert rows[("correction", "span_tag_f1")]["fraction"] == pytest.approx(1.0)
    assert rows[("feedback", "chrf")]["reliability"] == "weak"
    assert rows[("format", "validity_rate")]["value"] == 1.0
    assert ("calibration", "ece") in rows
    assert rows[("taxonomy", "other_rate")]["value"] == 0.0
    # Every band, empty ones too; tags of both sides; confusions; bins; notes without a value.
    assert rows[("meaning", "band.4.n")]["value"] == 6 and rows[("meaning", "band.2.n")]["value"] == 0
    assert rows[("meaning", "band.2.exact")]["value"] is None and rows[("meaning", "band.4.exact")]["value"] == pytest.approx(4 / 6)
    assert sum(r["value"] for (g, m), r in rows.items() if g == "taxonomy" and m.startswith("pred_tag.")) == rows[("correction", "predicted_edits")]["value"]
    assert rows[("correction", "confusion.sp->order.n")]["value"] == rows[("correction", "confusion.agr->tense.n")]["value"] == 1
    assert [rows[("calibration", f"bin.{k}.count")]["value"] for k in range(4)] == [2, 2, 2, 2]
    notes = [r for (g, _), r in rows.items() if g == "notes"]
    assert len(notes) == 1 and notes[0]["value"] is None and "weak" in notes[0]["metric"]
    unsure = predictions.withColumn("meaning_confidence", F.when(F.col("meaning_confidence") > 0.5, F.col("meaning_confidence")))
    assert len([r for r in score_report(unsure, ceilings, 4).collect() if r["grp"] == "notes"]) == 2
    with pytest.raises(ValueError, match="correction_edit_f1"):
        score_report(predictions, ceilings.where("metric = 'meaning_qwk'"))
    with pytest.raises(ValueError, match="not calibrated"):
        score_report(predictions, ceilings, config=BandConfig.of_taxonomy())


def test_coverage(predictions):
    flat = predictions.select("target", "text", "prediction.*")
    got = S.fixture_coverage(flat).first()
    assert got["failures"] == "no band_1, no usage"
    assert (got["rows"], got["unparseable"], got["verbatim"]) == (8, 1, 2)


@pytest.mark.parametrize(
    "a,b,want",
    [([0, 1, 2, 3, 4], [0, 1, 2, 3, 4], 1.0), ([2, 2, 2], [2, 2, 2], 1.0), ([0, 0, 0], [4, 4, 4], 0.0), ([], [], 0.0), ([0, 4], [4, 0], -1.0)],
)
def test_kappa_identities(spark, a, b, want):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert S.quadratic_weighted_kappa(df, "a", "b").first()["qwk"] == pytest.approx(want)


def test_edit_f1_identities(spark):
    kind = "array<struct<original:string,replacement:string,tag:string,start:int,end:int>>"
    one, other = ("a", "b", "sp", 0, 1), ("a", "b", "art", 0, 1)
    rows = [([], [], 1.0), ([one], [], 0.0), ([one], [other], 0.0), ([one, one], [one], 1.0), (None, [], 1.0), ([one], [one, other], 2 / 3)]
    df = spark.createDataFrame(rows, f"pred_edits {kind}, gold_edits {kind}, want double")
    got = df.select(S.edit_f1(F.col("pred_edits"), F.col("gold_edits")), "want").collect()
    assert all(r[0] == pytest.approx(r[1]) for r in got)


def test_chrf_by_hand(spark):
    rows = [("abc", "abc", 1.0), ("", "abc", 0.0), ("ab", "ba", 0.5), ("aab", "ab", (2 * 2 / 5 + 2 * 1 / 3) / 2), ("xyz", "abc", 0.0)]
    df = spark.createDataFrame(rows, "p string, g string, w double")
    got = df.select(S.chrf(F.col("p"), F.col("g")), "w").collect()
    assert all(r[0] == pytest.approx(r[1]) for r in got)


def test_equal_mass_bins(spark):
    rows = [(f"r{i:03d}", 0.9 if i < 70 else i / 100, i % 2 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id string, c double, ok boolean").repartition(6)
    bins = B.reliability_bins(df, "c", "ok")
    assert [r["count"] for r in bins.collect()] == [10] * 10
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    gaps = [abs(sum(r[1] for r in ordered[i : i + 10]) / 10 - sum(r[2] for r in ordered[i : i + 10]) / 10) for i in range(0, 100, 10)]
    assert B.ece(bins).first()["ece"] == pytest.approx(sum(gaps) / 10)
    for ok, want in ((True, 0.0), (False, 1.0)):
        sure = df.withColumn("c", F.lit(1.0)).withColumn("ok", F.lit(ok))
        assert B.ece(B.reliability_bins(sure, "c", "ok")).first()["ece"] == want


def test_judge(spark):
    rows = [("a", "forward", "A"), ("a", "backward", "it is b."), ("b", "forward", "B"), ("b", "backward", "A"), ("c", "forward", "A"), ("c", "backward", "A"), ("d", "forward", "??")]
    got = S.judge_summary(spark.createDataFrame(rows, "req_uid string, order string, reply string")).first()
    assert (got["n"], got["consistent"]) == (4, 2)
    assert (got["judge_win_rate"], got["judge_discard_rate"]) == (0.5, 0.5)


def counted_rows(spark, df):
    """``df`` and a counter of how many of its rows were evaluated."""
    seen = spark.sparkContext.accumulator(0)

    def tick(x):
        seen.add(1)
        return x

    first = df.columns[0]
    ticked = F.udf(tick, df.schema[first].dataType).asNondeterministic()
    return df.withColumn(first, ticked(first)), seen


def test_counters_evaluate_their_input_once(spark):
    from marginalia.operators import scoring as S_
    from marginalia.operators import tally as T_
    from marginalia.operators.corpus import import_stats

    def tags(values):
        return spark.createDataFrame([(v,) for v in values], "tag string")

    pred, seen = counted_rows(spark, tags(["sp", "sp", "other"]))
    rows = S_.taxonomy_report(pred, tags(["sp"])).collect()
    assert {r["tag"]: (r["pred_n"], r["gold_n"], r["gold_rate"]) for r in rows} == {"sp": (2, 1, 1.0), "other": (1, 0, 0.0)}
    assert seen.value == 3
    mix, seen = counted_rows(spark, spark.createDataFrame([(["sp", "art"],), (["sp"],)], "tags array<string>"))
    rows = S_.tag_mix_compare(mix, spark.createDataFrame([(["sp"],)], "tags array<string>")).collect()
    assert {r["tag"]: r["share_b"] for r in rows} == {"sp": 1.0, "art": 0.0} and seen.value == 2
    bad, seen = counted_rows(spark, spark.createDataFrame([("empty",), (None,), (None,)], "reject_reason string"))
    assert {r["reason"]: r["n"] for r in T_.reject_counts(bad).collect()} == {"empty": 1, "ok": 2} and seen.value == 3
    kinds = "drop_reason string, skipped array<string>, other_split array<string>, all_tags array<string>, edit_bucket string, cefr string"
    conv, seen = counted_rows(spark, spark.createDataFrame([(None, [], [], ["sp"], "one", "B1")] * 4, kinds))
    found = {(r["section"], r["key"]): r["n"] for r in import_stats(conv).collect()}
    assert found["converted", "all"] == found["tags", "sp"] == 4 and seen.value == 4


def test_a_bound_value_is_not_copied_and_read_once(spark):
    from marginalia.functions.arrays import bind, running_total

    df = spark.createDataFrame([([1, 2, 3] * 20,), ([],), ([4, None, 1],), (None,)], "v array<int>")
    got = [r[0] for r in df.select(running_total(F.col("v"))).collect()]
    assert got[0] == [sum(([1, 2, 3] * 20)[:i]) for i in range(61)] and got[1:] == [[0], [0, 4, None, None], None]
    bound = df.select(bind(F.struct(F.size("v").alias("n")), lambda s: F.struct((s["n"] + s["n"]).alias("x"))).alias("b"))
    assert [r["b"]["x"] for r in bound.collect()][:3] == [120, 0, 6]
    assert "transform(" not in bound._jdf.queryExecution().optimizedPlan().toString()


def test_one_side_of_the_edits_is_what_both_sides_give(spark, tmp_path):
    from marginalia.plans import derive as D_

    words = " ".join(f"word{i}" for i in range(30))
    docs = [(i, "en", "web", f"{words}\n{words} {i}\n") for i in range(12)] + [(20, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    both = D_.paired_edits(spark, str(tmp_path))
    for side, absent in (("gold", "% 11"), ("pred", "% 13 = 99")):
        one = D_.side_edits(spark, str(tmp_path), side)
        want = D_.edit_rows(both, f"{side}_edits")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.collect())) != []
        assert absent not in one._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_with_very_many_edits_is_not_paired_edit_by_edit(spark):
    import time

    n = 30_000
    kind = "array<struct<original:string,replacement:string,tag:string,start:int,end:int>>"

    def side(shift):
        made = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.struct(
                F.lit("a"), F.lit("b"), F.when((i + shift) % 3 == 0, "sp").otherwise("num"), i.cast("int") * 2, i.cast("int") * 2 + 1
            ),
        )
        return made.cast(kind)

    rows = spark.range(1).select(side(0).alias("pred_edits"), side(1).alias("gold_edits"))
    start = time.perf_counter()
    found = {(r["gold_tag"], r["pred_tag"]): r["n"] for r in S.tag_confusion(rows).collect()}
    scores = S.correction_scores(rows).first()
    f1 = S.edit_f1_macro(rows).first()[0]
    assert time.perf_counter() - start < 15
    assert found == {("num", "sp"): n // 3, ("sp", "num"): n // 3, ("num", "num"): n // 3}
    assert f1 == pytest.approx(1 / 3) and scores["span_only_f1"] == 1.0 and scores["tag_error_rate"] == pytest.approx(2 / 3)


def test_a_span_tagged_twice_keeps_the_smallest_predicted_and_the_largest_gold_tag(spark):
    kind = "array<struct<original:string,replacement:string,tag:string,start:int,end:int>>"
    pred = [("a", "b", "sp", 0, 1), ("a", "b", "num", 0, 1), ("c", "d", "sp", 4, 5)]
    gold = [("a", "b", "art", 0, 1), ("a", "b", "word", 0, 1), ("x", "y", "sp", 4, 6)]
    rows = spark.createDataFrame([(pred, gold), (pred, None)], f"pred_edits {kind}, gold_edits {kind}")
    assert [tuple(r) for r in S.tag_confusion(rows).collect()] == [("word", "num", 1)]


def test_tokens_without_offsets_are_the_tokens_of_units(spark):
    from marginalia.functions.text import unit_tokens, units

    texts = ["He didn't go, did\the?", "  a b  (c) ", "", "n't", "état 𝒳_1 — x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = df.select(unit_tokens(F.col("t")).alias("a"), F.transform(units(F.col("t")), lambda u: u["token"]).alias("b"))
    for r in made.collect():
        assert r["a"] == r["b"]


def opcodes(rows):
    made = [(r, *c) for r, (a, b) in enumerate(rows) for c in difflib.SequenceMatcher(None, a, b).get_opcodes()]
    return [(r, i, j, k, m) for r, op, i, j, k, m in made if op != "equal"]


@pytest.mark.parametrize("most", [1 << 22, 50])
def test_a_batch_is_aligned_as_by_the_standard_matcher(monkeypatch, most):
    import random

    from marginalia.functions import alignment

    monkeypatch.setattr(alignment, "PAIRS", most)
    rnd, rows = random.Random(4), [([], []), ([1], []), ([], [1]), ([1] * 300, [1] * 250)]
    for size, known in [(s, v) for s in (3, 12, 60, 250, 500) for v in (2, 6, 40, 400)] * 3:
        a = [int(known * rnd.random() ** 2) for _ in range(size)]
        b = [rnd.choice([[w], [w], [w], [w, -1], [known], []]) for w in a]
        rows += [(a, [w for x in b for w in x]), (a, a[size // 2 :] + a[: size // 2]), (a, [int(known * rnd.random()) for _ in a])]

    def side(n):
        starts = np.cumsum([0] + [len(x[n]) for x in rows])
        return np.array([w for x in rows for w in x[n]], np.int64), starts

    (a, i), (b, j) = side(0), side(1)
    got = zip(*[x.tolist() for x in alignment.aligned(a, i, b, j)])
    assert [(r, x - i[r], y - i[r], z - j[r], w - j[r]) for r, x, y, z, w in got] == opcodes(rows)


def test_a_long_text_with_many_edits_is_aligned_without_looking_through_it_for_each():
    import time

    from marginalia.functions import alignment

    a = np.arange(40_000)
    b = np.where(a % 7 == 3, -1, a)
    ends = np.array([0, 40_000])
    start = time.process_time()
    found = alignment.aligned(a, ends, b, ends)
    assert time.process_time() - start < 5
    assert found[1].tolist() == list(range(3, 40_000, 7)) == found[3].tolist()


def test_rewrites_with_letters_of_new_scripts_score_as_the_standard_matcher_has_it(spark):
    from marginalia.functions.text import unit_tokens
    from marginalia.operators.scoring import rewrite_scores

    rows = [
        ("a dog don't ran.", "a cat don't run.", "a cat don't ran."), ("ࡰ b c", "ࡰ c", "ࡰb c"), ("😀 中文 é", "😀 é é", "中文 é"),
        ("x ₹ ⅷ y", "x ₹ y", "x ⅷ y"), ("e Ꟁf g", "e f g", "e f"),
    ]
    df = spark.createDataFrame(rows, "text string, prediction string, reference string")
    tokens = [list(r) for r in df.select(*[unit_tokens(F.col(c)) for c in df.columns]).collect()]

    def edits(a, b):
        return {(i, j, " ".join(b[k:m])) for _, i, j, k, m in opcodes([(a, b)])}

    pred, gold = [edits(t, p) for t, p, _ in tokens], [edits(t, g) for t, _, g in tokens]
    both, n = sum(len(p & g) for p, g in zip(pred, gold)), sum(map(len, pred))
    got = rewrite_scores(df).first()
    assert got["edit_precision"] == pytest.approx(both / n)
    assert got["edit_recall"] == pytest.approx(both / sum(map(len, gold)))
