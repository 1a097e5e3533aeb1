"""Curation, corpus, logs, streams, timing and rollouts on small tables."""

import difflib
import hashlib
import json
import math
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marginalia.operators import calibration as B
from marginalia.operators import corpus as K
from marginalia.operators import curate as C
from marginalia.operators import gates as X
from marginalia.operators import joins as J
from marginalia.operators import log as L
from marginalia.operators import requests as Q
from marginalia.operators import rollouts as O
from marginalia.operators import timing as M
from marginalia.plans import flows
from marginalia.schemas import POOL, PROFILES, check_band_config, GROUPS, TAGS, THRESHOLDS, USAGE_TAGS, WEIGHTS
from marginalia.sources import readers, sinks
from marginalia.streaming import changelog as G


def test_senses_meet_their_first_reason(spark):
    senses = spark.createDataFrame(
        [
            (1, 10, "to move fast", "A1"), (2, 10, "to move fast", "A1"), (3, 10, " ", "A1"), (4, 10, "ab", ""),
            (5, 11, "a thing here", ""), (6, 12, "of a kind", "B1"), (7, 13, "some thing", "B1"), (8, 99, "no entry", ""),
        ],
        "id int, entry_id int, definition string, cefr_level string",
    )
    entries = spark.createDataFrame(
        [(10, "Run", "v"), (11, " ", "noun"), (12, "of", "preposition"), (13, "x", "strange")],
        "id int, headword string, pos string",
    )
    pool, refused = C.sense_quarantine(readers.scan_senses(senses, entries))
    assert [(r["source_sense_id"], r["target_norm"], r["pos"]) for r in pool.collect()] == [("1", "run", "verb")]
    got = {r["source_sense_id"]: r["reason"] for r in refused.collect()}
    assert got == {
        "2": "duplicate_uid", "3": "empty_definition", "4": "definition_too_short",
        "5": "empty_target", "6": "excluded_pos", "7": "unmappable_pos",
    }
    uid = hashlib.sha256(b"run|verb|to move fast").hexdigest()[:16]
    assert pool.first()["sense_uid"] == uid


def test_cap_keeps_rare_strata(spark):
    rows = [(f"r{i}", "clean") for i in range(960)] + [(f"q{i}", "many") for i in range(40)]
    df = spark.createDataFrame(rows, "row_uid string, edit_bucket string")
    for parts in (1, 4, 50):
        kept = C.cap_strata(df.repartition(parts), ["edit_bucket"], 0.15, 20)
        counts = {r["edit_bucket"]: r["n"] for r in kept.groupBy("edit_bucket").agg(F.count("*").alias("n")).collect()}
        assert counts == {"clean": 150, "many": 40}
    order = sorted((hashlib.sha256(f"20|r{i}".encode()).hexdigest(), f"r{i}") for i in range(960))
    ids = {r["row_uid"] for r in kept.where("edit_bucket = 'clean'").collect()}
    assert ids == {u for _, u in order[:150]}


def test_groups_stay_in_one_split(spark):
    rows = [(f"t{i % 30}", f"text {i % 50}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "target_norm string, text string, i int")
    split = C.group_split(df, ["target_norm"], 1)
    assert split.groupBy("target_norm").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    back = C.group_split(df.orderBy(F.desc("i")).repartition(7), ["target_norm"], 1)
    assert {(r["i"], r["split"]) for r in split.collect()} == {(r["i"], r["split"]) for r in back.collect()}
    with pytest.raises(Exception, match="needs a group"):
        C.group_split(df.withColumn("target_norm", F.lit("")), "target_norm", 1).collect()
    with pytest.raises(ValueError):
        C.group_split(df, "target_norm", 1, 0.9, 0.1)


def test_leakage(spark):
    df = spark.createDataFrame(
        [("same", "train"), ("same", "test"), ("new", "test"), ("new", "test"), ("v", "val")], "text string, split string"
    )
    assert sorted(r["text"] for r in C.strict_test(df).collect()) == ["new", "new"]
    assert C.contamination(df).first().asDict() == {"cross_split_text_hashes": 1, "train": 1, "val": 1, "test": 3}
    assert C.text_overlap(df).count() == 1
    assert C.strict_test(df, small_rows=1).count() == 2


def test_sampling_is_nested_and_cells_are_distinct(spark):
    df = spark.createDataFrame([(f"s{i}", i % 5 == 0) for i in range(200)], "sense_uid string, is_multiword boolean")

    def ids(n):
        return {r["sense_uid"] for r in Q.quota_sample(df, n, 4).collect()}

    small, large = ids(20), ids(120)
    assert len(small) == 20 and len(large) == 120 and small <= large
    assert len(ids(500)) == 200 and ids(0) == set()
    drawn = Q.draw_cells(df, 6, {0: 0.0}, None, 3).select("cells").collect()
    assert all(len({tuple(c) for c in r["cells"]}) == 6 for r in drawn)
    assert all(c["meaning_req"] > 0 for r in drawn for c in r["cells"])
    many = Q.draw_cells(df.limit(3), 30, None, None, 3).collect()
    assert all(len(r["cells"]) == 30 and len({tuple(c) for c in r["cells"]}) == 25 for r in many)


def test_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(4000)], "sense_uid string")
    weights = {0: 1.0, 1: 2.0, 2: 4.0, 3: 2.0, 4: 1.0}
    first = Q.draw_cells(df, 1, weights, None, 8).select(F.col("cells")[0]["meaning_req"].alias("m"))
    got = {r["m"]: r["n"] / 4000 for r in first.groupBy("m").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[m] - w / 10) < 0.03 for m, w in weights.items())


def test_corpus_conversion(spark, tmp_path):
    text = (
        "S She go to school .\nA 1 2|||R:VERB:SVA|||goes|||REQUIRED|||-NONE-|||0\n"
        "A 0 1|||R:PRON|||He|||REQUIRED|||-NONE-|||1\n\n"
        "S I like cat , do n't I ?\nA 2 2|||M:DET|||the|||REQUIRED|||-NONE-|||0\n\n\n"
        "S ( Fine ) it 's 5 %\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\n\n"
        "S a b c\nA 0 2|||R:OTHER|||x y|||REQUIRED|||-NONE-|||0\nA 1 3|||R:NOUN|||z|||REQUIRED|||-NONE-|||0\n\n"
        "S a b c\nA 0 9|||R:NOUN|||z|||REQUIRED|||-NONE-|||0\n\n"
        "S a b c\nA 0 1|||R:ODD|||z|||REQUIRED|||-NONE-|||0\nS one two\nA 0 1|||R:OTHER|||uno|||REQUIRED|||-NONE-|||0\n\n"
        "S a b c\nA 0 1|||R:NOUN|||x:y|||REQUIRED|||-NONE-|||0\n"
    )
    (tmp_path / "B.train.m2").write_text(text)
    blocks = readers.scan_m2(spark, str(tmp_path))
    assert blocks.count() == 8 and blocks.first()["cefr"] == "B"
    rows = {r["text"] + "|" + str(r["drop_reason"]): r for r in K.convert_corpus(blocks).collect()}
    kept = {r["text"]: r["correction"] for r in rows.values() if r["drop_reason"] is None}
    assert kept == {
        "She go to school.": "She [go>goes:agr] to school.",
        "I like cat, don't I?": "I like [>the:art] cat, don't I?",
        "(Fine) it's 5%": "(Fine) it's 5%",
        "one two": "[one>uno:word] two",
    }
    reasons = sorted(str(r["drop_reason"]) for r in rows.values() if r["drop_reason"])
    assert reasons == ["overlapping_edits", "reparse:malformed_edit", "span_out_of_range", "unmapped_type:R:ODD"]
    with pytest.raises(ValueError, match="converted 50.00%"):
        K.import_stats(K.convert_corpus(blocks))
    stats = {(r["section"], r["key"]): r["n"] for r in K.import_stats(K.convert_corpus(blocks), 0.4).collect()}
    assert stats[("skipped_edits", "noop")] == 1 and stats[("converted", "all")] == 4
    assert stats[("other_split", "unnat")] == 1 and stats[("other_split", "word")] == 1


@pytest.mark.parametrize("bad", ["A 0 1|||R:X|||y|||R|||N|||0\n", "S a\nA 0 1|||R:X|||y\n", "S a\nA 0|||R:X|||y|||R|||N|||0\n"])
def test_malformed_corpus_is_an_error(spark, tmp_path, bad):
    (tmp_path / "A.m2").write_text(bad)
    with pytest.raises(Exception, match="without a sentence above|malformed annotation"):
        readers.scan_m2(spark, str(tmp_path)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"one")
    (tmp_path / "y.bin").write_bytes(b"two")
    prints = readers.file_fingerprint(spark, str(tmp_path))
    got = {r["file"]: r["sha256"] for r in prints.collect()}
    assert got == {"x.bin": hashlib.sha256(b"one").hexdigest(), "y.bin": hashlib.sha256(b"two").hexdigest()}
    whole = readers.corpus_digest(prints).first()
    assert whole["files"] == 2 and whole == readers.corpus_digest(prints.repartition(3)).first()
    deep = readers.corpus_digest(prints, levels=2).first()
    assert deep["files"] == 2 and deep["corpus_sha256"] != whole["corpus_sha256"]


def test_registered_digest_deepens_with_the_table(spark, tmp_path, monkeypatch):
    from marginalia.plans import catalog

    monkeypatch.setattr(readers, "FAN_IN", 2)
    rows = [(i, f"http://x/{i}", f"page {i}") for i in range(60)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    # 60 entries fit 2 to a group at a depth of 2.
    node = [(sha(f"page-{i}"), sha(f"page-{i}|{sha(html)}")) for i, _, html in rows]
    for level in (2, 1, 0):
        groups = {}
        for place, digest in node:
            groups.setdefault(place[:level], []).append(digest)
        node = [(place, sha(",".join(sorted(some)))) for place, some in groups.items()]
    got = catalog.QUERIES["corpus_digest"](spark, str(tmp_path)).first()
    assert (got["files"], got["corpus_sha256"]) == (60, node[0][1])


def test_profiles_contract(spark, tmp_path):
    good = {"id": "a", "l1": "x", "cefr": "B1", "error_bias": ["sp"], "length": "short", "traits": "t"}
    cases = {
        "share an id": [good, good],
        "unknown": [{**good, "error_bias": ["zzz"]}],
        "missing field": [{**good, "traits": " "}],
        "lists nothing": [],
    }
    for message, rows in cases.items():
        path = tmp_path / f"{message.split()[0]}.json"
        path.write_text(json.dumps(rows))
        with pytest.raises(ValueError, match=message):
            readers.scan_profiles(spark, str(path))
    (tmp_path / "ok.json").write_text(json.dumps([good]))
    assert readers.scan_profiles(spark, str(tmp_path / "ok.json")).schema == PROFILES


def test_predictions_need_their_fields(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"req_uid": "a", "text": "t", "gold": {}}\n')
    with pytest.raises(Exception, match="missing prediction"):
        readers.scan_predictions(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "ok.jsonl").write_text('{"req_uid": "a", "text": "t", "gold": {"meaning": 1}, "prediction": null}\n\n')
    assert readers.scan_predictions(spark, str(tmp_path / "ok.jsonl")).first()["prediction"] is None


def test_fixed_schema_sink(spark, tmp_path):
    rows = spark.range(120_000).select(
        *[F.lit(True if f.dataType.typeName() == "boolean" else "x").alias(f.name) for f in POOL if f.name != "sense_uid"],
        F.sha2(F.col("id").cast("string"), 256).alias("sense_uid"),
    )
    sinks.sink_fixed_schema(rows.coalesce(1), POOL, str(tmp_path / "t"), "sense_uid")
    files = sorted((tmp_path / "t").glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) == 120_000 and max(groups) <= 50_000
    ids = [x for f in files for x in pq.read_table(f, columns=["sense_uid"])["sense_uid"].to_pylist()]
    assert ids == sorted(ids)
    with pytest.raises(ValueError, match="missing"):
        sinks.as_schema(rows.drop("cefr"), POOL)


def test_length_and_split_gates(spark):
    df = spark.createDataFrame([("a b c",), ("a",)], "text string")
    with pytest.raises(ValueError, match="1 of 2"):
        sinks.length_filter(df, 2)
    assert sinks.length_filter(df, 2, 0.5).count() == 1
    with pytest.raises(ValueError, match="no rows in split"):
        sinks.split_nonempty_gate(df.withColumn("split", F.lit("train")), ["train", "val"])


def test_strict_join_refuses_orphans(spark):
    texts = spark.createDataFrame([("a", "t", 1)], "req_uid string, text string, seed int")
    labels = spark.createDataFrame([("a", 2), ("b", 3)], "req_uid string, seed int")
    assert J.join_texts_labels(texts, labels).first().asDict() == {"text": "t", "req_uid": "a", "seed": 2}
    with pytest.raises(ValueError, match="'b' has no text"):
        J.join_texts_labels_strict(texts, labels)


def test_latest_and_pending(spark):
    log = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, None), ("b", 2, "y"), ("b", 1, "z")], "key string, seq int, response string"
    )
    live = L.latest_by_key(log, "key", "seq", F.col("response").isNull())
    assert [tuple(r) for r in live.collect()] == [("b", 2, "y")]
    with pytest.raises(ValueError, match="sequence"):
        L.latest_by_key(log, "key", "missing")
    asked = spark.createDataFrame([("a",), ("b",)], "req_uid string")
    done = spark.createDataFrame([("a",), ("b#p1",)], "req_uid string")
    assert [r[0] for r in L.pending_requests(asked, done).collect()] == ["b"]
    assert [r[0] for r in L.pending_requests(asked, done, 1).collect()] == ["a"]


def test_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    schema = "req_uid string, seq long, reply string"
    rows = [(f"k{i % 4}", i, None if i % 5 == 0 else f"v{i}") for i in range(40)]
    lines = [json.dumps({"req_uid": k, "seq": s, "reply": r}) for k, s, r in rows]
    kind = spark.createDataFrame([], schema).schema
    out = str(tmp_path / "out")
    for part in (0, 1):
        (log / f"{part}.txt").write_text("\n".join(lines[part::2] + ["", '{"torn": ', "[1]"]) + "\n")
        stream = G.read_log_stream(spark, str(log), kind, "req_uid").where("bad_line is null").drop("bad_line")
        G.run_updates(G.stream_latest_state(stream, "req_uid", "seq"), str(tmp_path / "ck"), out)
    state = {r["req_uid"]: (r["seq"], r["reply"]) for r in G.settled(spark, out, "req_uid").collect()}
    batch = L.latest_by_key(spark.createDataFrame(rows, schema), "req_uid", "seq")
    assert state == {r["req_uid"]: (r["seq"], r["reply"]) for r in batch.collect()}
    bad = readers.scan_jsonl_log(spark, str(log), kind, keep_bad=True).where("bad_line is not null")
    assert bad.count() == 4


def test_timing(spark):
    rows = [(float(i), i * 0.1, float(i), 11, i != 50, i <= 5) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "started_s double, ttft_s double, latency_s double, output_tokens int, ok boolean, warmup boolean")
    got = M.bench_statistics(df, slo_s=60.0, cost_per_hour=3.6).first()
    kept = [r for r in rows if r[4] and not r[5]]
    span = max(r[0] + r[2] for r in kept) - min(r[0] for r in kept)
    assert (got["requests"], got["warmup_discarded"], got["failures"]) == (94, 5, 1)
    assert got["tokens_per_s"] == pytest.approx(94 * 11 / span)
    assert got["goodput_per_s"] == pytest.approx(sum(r[2] <= 60 for r in kept) / span)
    assert got["cost_per_1k_requests"] == pytest.approx(3.6 / 3600 * span / 94 * 1000)
    cdf = [r["latency_s"] for r in M.latency_cdf(df).orderBy("p").collect()]
    assert len(cdf) == 101 and cdf == sorted(cdf) and (cdf[0], cdf[-1]) == (6.0, 100.0)
    with pytest.raises(Exception, match="no spread"):
        M.variance_across_runs(df.limit(1), "ttft_s").collect()
    systems = spark.createDataFrame(
        [("slow", 0.9, 9.0, 1.0), ("free", 0.9, 1.0, None), ("small", 0.6, 1.0, 0.5), ("large", 0.8, 1.0, 1.0)],
        "system string, qwk double, e2e_p95_s double, cost double",
    )
    ranked = M.quality_per_dollar(systems, 5.0)
    assert {r["system"]: r["quality_per_dollar"] for r in ranked.collect()} == {"slow": 0.0, "free": None, "small": 1.2, "large": 0.8}
    assert M.best_system(ranked).first()[0] == "small"
    assert {r["system"]: r["rank"] for r in M.rank_systems(ranked).collect()} == {"small": 1, "large": 2}


def test_rollouts(spark):
    rows = [("flat", i, 0.5, 0.1, 10) for i in range(4)] + [("mixed", i, float(i), 1.0, 20) for i in range(4)]
    df = spark.createDataFrame(rows, "group_id string, rollout_id int, reward double, empty_reward double, tokens int")
    gains = [max(0.0, r[2] - r[3]) for r in rows[4:]]
    mean = sum(gains) / 4
    std = math.sqrt(sum((g - mean) ** 2 for g in gains) / 4)
    for limits in ({}, {"small_rows": 1}):
        got = {(r["group_id"], r["rollout_id"]): r["advantage"] for r in O.group_advantage(df, **limits).collect()}
        assert all(got[("flat", i)] == 0.0 for i in range(4))
        assert all(got[("mixed", i)] == pytest.approx((g - mean) / std) for i, g in enumerate(gains))
    health = O.rollout_health(df).first()
    assert health["zero_advantage_share"] == 0.5 and health["empty_gap"] == pytest.approx(1.0 - 0.55)
    assert health["advantage_std"] == pytest.approx(math.sqrt(0.5))
    bound = {r["group_id"]: r["bound"] for r in O.multi_sample_bound(df).collect()}
    assert bound["mixed"] == pytest.approx(math.log(sum(math.exp(i) for i in range(4)) / 4))
    toks = spark.createDataFrame([("a", 0.5, 0.9), ("a", 0.0, 0.2)], "seq_id string, p double, base double")
    floor = math.log(1e-12)
    assert O.logprob_aggregates(toks, "seq_logp").first()["seq_logp"] == pytest.approx(math.log(0.5) + floor)
    w = [-math.log(0.9), -math.log(0.2)]
    want = (w[0] * math.log(0.5) + w[1] * floor) / sum(w)
    assert O.logprob_aggregates(toks, "weighted_neglogp", "base").first()["weighted_neglogp"] == pytest.approx(want)
    with pytest.raises(Exception, match="outside 0..1"):
        O.logprob_aggregates(toks.withColumn("p", F.lit(1.5)), "seq_logp").collect()
    with pytest.raises(Exception, match="align"):
        O.kl_estimate(spark.createDataFrame([(0.1, None)], "policy double, reference double")).collect()


def test_reward(spark):
    gold = spark.createDataFrame([("a", "he go", "he [go>goes:agr]", 3, "Fix the verb.")], "req_uid string, text string, correction string, meaning int, feedback string")
    answers = [
        ("he [go>goes:agr]", 3, "Fix the verb.", 1.0),
        ("he [go>goes:tense]", 1, "Fix it.", 0.3 * 0.5 + 0.2),
        ("she [go>goes:agr]", 3, "Fix it.", 0.0 + 0.3 - 1.0),
        ("he [go", 9, "", -1.0),
    ]
    rows = [(i, "a", a[:3]) for i, a in enumerate(answers)] + [(9, "a", None)]
    df = spark.createDataFrame(rows, "rollout_id int, req_uid string, answer struct<correction:string,meaning:int,feedback:string>")
    got = {r["rollout_id"]: r["total"] for r in O.verifiable_reward(df, gold).collect()}
    assert all(got[i] == pytest.approx(a[3]) for i, a in enumerate(answers)) and got[9] == 0.0
    full = {r["rollout_id"]: r["total"] for r in O.verifiable_reward(df, gold, scope="full_answer").collect()}
    assert full[0] == pytest.approx(1.2) and full[9] == 0.0


def test_calibration_guards(spark):
    p = spark.createDataFrame([(0.0,)] * 80 + [(1.0,)] * 20, "penalty double")
    cuts = B.uniform_thresholds(p)
    assert not B.threshold_guard(cuts, p).first()["passed"]
    with pytest.raises(ValueError, match="80.0%"):
        B.assert_distinct_thresholds(cuts, p)
    even = spark.createDataFrame([(float(i),) for i in range(101)], "penalty double").repartition(5)
    assert B.assert_distinct_thresholds(B.uniform_thresholds(even), even) == [20.0, 40.0, 60.0, 80.0]
    banded = spark.createDataFrame([(float(4 - b), b) for b in range(5)], "penalty double, band int")
    fit = [r["threshold"] for r in B.fit_thresholds(banded).orderBy("cut").collect()]
    assert fit == [0.5, 1.5, 2.5, 3.5]
    with pytest.raises(Exception, match="no row of band 2"):
        B.fit_thresholds(banded.where("band <> 2")).collect()
    groups = {GROUPS[0]: [t for t in TAGS if t not in USAGE_TAGS], GROUPS[1]: USAGE_TAGS}
    check_band_config(WEIGHTS, groups, THRESHOLDS)
    with pytest.raises(ValueError, match="ascending"):
        check_band_config(WEIGHTS, groups, [0.4, 0.0, 0.9, 1.6])


def test_gates(spark):
    good = {
        "self_consistency_qwk": 0.8, "self_consistency_edit_f1": 0.5, "middle_band_share": 0.5, "empty_bands": 0.0,
        "format_validity": 0.95, "mean_distinct2": 0.7, "other_tag_share": 0.01, "batch_single_qwk": 1.0,
    }
    df = spark.createDataFrame(list(good.items()), "metric string, value double")
    got = {r["name"][:2]: r["passed"] for r in X.pilot_gate(df).collect()}
    assert got == {"G1": False, "G2": True, "G3": True, "G4": False, "G5": True, "G6": True}
    manual = df.unionByName(spark.createDataFrame([("manual_review", 1.0)], df.schema))
    assert X.pilot_gate(manual).count() == 7


def test_rewrites_align_as_the_standard_library_does(spark):
    from marginalia.operators import scoring as S

    rows = [
        ("he go home now", "he goes home now", "he [go>goes:agr] home [now>:word]"),
        ("all is well", "all is well", "all is well"),
        ("bad text", "null", "[bad>good:word] text"),
        ("lost", "null", "null"),
        ("lost", "found", "null"),
    ]
    df = spark.createDataFrame(rows, "text string, prediction string, reference string")

    def align(a, b):
        ops = difflib.SequenceMatcher(None, a.split(), b.split()).get_opcodes()
        return {(i, j, " ".join(b.split()[k:m])) for op, i, j, k, m in ops if op != "equal"}

    pred = align(rows[0][0], rows[0][1])
    gold = align(rows[0][0], "he goes home")
    hit, n_pred, n_gold = len(pred & gold), len(pred), len(gold) + len(align("bad text", "good text"))
    p, r = hit / n_pred, hit / n_gold
    got = S.rewrite_scores(df).first()
    assert got["edit_precision"] == pytest.approx(p) and got["edit_recall"] == pytest.approx(r)
    assert got["edit_f05"] == pytest.approx(1.25 * p * r / (0.25 * p + r))
    assert got["clean_accuracy"] == 1.0 and got["null_accuracy"] == 0.5
    assert got["exact_match"] == pytest.approx(1 / 5)


def test_repeated_keys_and_odd_numbers_in_replies(spark):
    from marginalia.operators.grading import check_rows, parse_responses

    replies = [
        ('{"correction":"a","meaning":1,"meaning":2,"feedback":" fine. "}', 2, None, "fine."),
        ('{"correction":"a","meaning":NaN,"feedback":"fine."}', None, "bad_type", "fine."),
        ('{"correction":"a","meaning":12345678901234567890123,"feedback":"fine."}', None, "meaning_range", "fine."),
        ('{"correction":"a","meaning":2.0,"feedback":"fine."}', None, "bad_type", "fine."),
        ('{"correction":"a","meaning":2}', 2, "missing_field", None),
    ]
    df = spark.createDataFrame([(i, "a", r[0]) for i, r in enumerate(replies)], "i int, text string, reply string")
    got = {r["i"]: r for r in check_rows(parse_responses(df)).collect()}
    for i, (_, meaning, reason, feedback) in enumerate(replies):
        assert (got[i]["meaning"], got[i]["reject_reason"], got[i]["feedback"]) == (meaning, reason, feedback)


@pytest.mark.parametrize("learners", [True, False])
def test_profiles_by_constant_and_by_join_agree(spark, learners):
    senses = spark.createDataFrame([(f"s{i}",) for i in range(30)], "sense_uid string")
    drawn = Q.draw_cells(senses, 6, None, None, 3)
    registry = [(f"p{i}", "none" if i % 3 == 0 or not learners else "de") for i in range(11)]
    profiles = spark.createDataFrame(registry, "id string, l1 string")
    cols = ["sense_uid", "cells"]
    ways = [sorted(map(repr, Q.draw_profile(drawn, profiles, 5, small).select(*cols).collect())) for small in (10_000, 1)]
    assert ways[0] == ways[1] and len(ways[0]) == 30


def numbered_log(n=60):
    return [(f"k{i * 7 % 9}", i, None if i % 5 == 0 else f"v{i}") for i in range(n)]


def test_state_is_kept_as_generations(spark, tmp_path):
    import os

    schema = "key string, seq bigint, reply string"
    kind = spark.createDataFrame([], schema).schema
    rows, out = numbered_log(), str(tmp_path / "out")
    late = rows[::2][::-1] + rows[1::2]  # rows of one batch may be older than those before it
    state = G.latest_rows(spark, out, kind, "key", "seq", every=3)
    for number in range(8):
        batch = spark.createDataFrame(late[number::8], schema)
        state.add(batch, number)
        state.add(batch, number)  # a batch that is tried again
        seen = [r for k in range(number + 1) for r in late[k::8]]
        want = sorted(map(tuple, L.latest_by_key(spark.createDataFrame(seen, schema), "key", "seq").collect()))
        # A new object finds what the old one left, as a run that starts again does.
        again = G.latest_rows(spark, out, kind, "key", "seq", every=3)
        assert sorted(map(tuple, again.read().collect())) == want
        assert len(os.listdir(f"{out}/change")) < 3
    assert len(os.listdir(f"{out}/whole")) == len([f for f in os.listdir(f"{out}/pointer") if not f.startswith(".")]) == 1
    # A generation that was not finished has no pointer and is not read.
    spark.createDataFrame([("k0", 999, "x")], schema).write.parquet(f"{out}/whole/{99:012d}")
    assert sorted(map(tuple, state.read().collect())) == want
    assert G.latest_rows(spark, str(tmp_path / "none"), kind, "key", "seq").read().count() == 0


def test_streamed_state_equals_batch_after_a_restart(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    schema = "key string, seq bigint, reply string"
    kind = spark.createDataFrame([], schema).schema
    rows = numbered_log()
    for part in range(4):
        (log / f"{part}.txt").write_text("\n".join(json.dumps(dict(zip(("key", "seq", "reply"), r))) for r in rows[part::4]) + "\n")
        stream = G.read_log_stream(spark, str(log), kind, "key", files=1).drop("bad_line")
        state = G.latest_rows(spark, str(tmp_path / "out"), kind, "key", "seq", every=2)
        G.stream_state(stream, str(tmp_path / "ck"), state)
    batch = L.latest_by_key(spark.createDataFrame(rows, schema), "key", "seq")
    assert sorted(map(tuple, state.read().collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_are_counted_apart(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    hours = [[0, 1, 1, 5, 30, None], [2, 25, 23, 29, 60], [1, 50, 59, 61]]
    schema = "id bigint, ts timestamp, kind string"
    kind = spark.createDataFrame([], schema).schema
    log = tmp_path / "log"
    log.mkdir()
    want, newest = {}, None
    for wave, hs in enumerate(hours):
        limit = None if newest is None else newest - 6
        lines = []
        for i, h in enumerate(hs):
            lines.append(json.dumps({"id": i, "ts": None if h is None else (start + timedelta(hours=h)).isoformat(), "kind": "ab"[i % 2]}))
            window = None if h is None else start + timedelta(days=h // 24)
            too_late = h is None or (limit is not None and (h // 24 + 1) * 24 <= limit)
            counts = want.setdefault((window, "ab"[i % 2]), [0, 0])
            counts[too_late] += 1
        newest = max([h for h in hs if h is not None] + ([newest] if newest is not None else []))
        (log / f"{wave}.txt").write_text("\n".join(lines) + "\n")
        stream = G.read_log_stream(spark, str(log), kind, "id").drop("bad_line")
        counts = G.window_counts(spark, str(tmp_path / "out"), every=2)
        G.stream_event_counts(stream, str(tmp_path / "ck"), counts, "ts", "kind", "1 day", "6 HOURS")
    got = {(r["window_start"], r["kind"]): [r["n"], r["late"]] for r in G.event_counts(counts).collect()}
    assert got == want and sum(x[1] for x in got.values()) >= 3


def test_diversity_moves_no_strings_and_sketches_come_close(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(90)]
    rows = [(f"b{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [("b3", None), ("b3", "one"), (None, "a b a b")]
    df = spark.createDataFrame(rows, "b string, t string")
    found = Q.batch_diversity(df, "b", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("gram" not in line for line in plan.splitlines() if "Exchange" in line)
    got = {r["batch_uid"]: r for r in found.collect()}
    for b in ("b0", "b1", "b2", "b3", None):
        texts = [(t or "").split() for k, t in rows if k == b]
        assert got[b]["texts"] == len(texts)
        for n in (2, 3):
            grams = [tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1)]
            assert got[b][f"distinct{n}"] == pytest.approx(len(set(grams)) / len(grams) if grams else 1.0)
    half = F.hash("t") % 2 == 0
    parts = Q.diversity_sketches(df.where(half), "b", "t").union(Q.diversity_sketches(df.where(~half), "b", "t"))
    near = {r["batch_uid"]: r for r in Q.diversity_of_sketches(parts).collect()}
    assert set(near) == set(got)
    for b, r in near.items():
        assert r["texts"] == got[b]["texts"]
        for n in (2, 3):
            assert r[f"distinct{n}"] == pytest.approx(got[b][f"distinct{n}"], rel=0.03)


@pytest.mark.parametrize("least", [300, 3000, 1 << 20])
def test_diversity_is_exact_and_moves_no_row_per_ngram(spark, least, monkeypatch):
    monkeypatch.setattr(Q, "SENT_BYTES", 2000)
    rng = random.Random(5)
    words = ["a", "b'", "Ü", "K9", "z" * 30] + [f"w{i}" for i in range(40)]
    rows = [(rng.choice(["b0", "b0", "b1", None]), rng.choice([" ", "\n", " é-"]).join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(400)]
    rows += [("b2", "one"), ("b3", None), ("b4", "a b a b a")]
    df = spark.createDataFrame(rows, "b string, t string").repartition(5)
    shares = Q.batch_diversity(df, "b", "t", least=least)
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert ("MapInArrow" in plan) == (least < 1 << 20) and "Generate" not in plan
    got = {r["batch_uid"]: r for r in shares.collect()}
    assert set(got) == {"b0", "b1", "b2", "b3", "b4", None}
    for b, r in got.items():
        texts = [re.findall("[a-z0-9']+", (t or "").lower()) for k, t in rows if k == b]
        assert r["texts"] == len(texts)
        for n in (2, 3):
            every = [tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1)]
            assert r[f"distinct{n}"] == (len(set(every)) / len(every) if every else 1.0)
    assert Q.batch_diversity(df.where("false"), "b", "t", least=least).count() == 0


def test_many_numbers_are_ranked_before_they_are_joined():
    import numpy as np

    from marginalia.functions import neighbours

    rng = np.random.default_rng(1)
    place, ids = rng.integers(0, 3, 500) * (1 << 29), rng.integers(0, 3, (3, 500)) * (1 << 30)
    at, new_pair = neighbours._distinct(place, ids)
    every = list(zip(place.tolist(), *ids.tolist()))
    assert sorted(every[i] for i in at) == sorted(set(every))
    assert new_pair.sum() == len({x[:3] for x in every})


@pytest.mark.parametrize("values", [3, 1000])
def test_bins_from_counts_equal_bins_of_a_sorted_table(spark, values):
    rng = random.Random(values)
    rows = [(f"id{i:03d}", None if i % 40 == 0 else rng.randrange(values) / values, rng.random() < 0.5) for i in range(333)]
    df = spark.createDataFrame(rows, "row_id string, c double, ok boolean").repartition(4)
    ordered = sorted((c, i, ok) for i, c, ok in rows if c is not None)
    edges = [0, *[round(len(ordered) * (k + 1) / 10) for k in range(9)], len(ordered)]
    want = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = ordered[a:b]
        want.append((k, part[0][0], part[-1][0], len(part), pytest.approx(sum(x[0] for x in part) / len(part)), pytest.approx(sum(x[2] for x in part) / len(part))))
    got = B.reliability_bins(df, "c", "ok")
    # The rows themselves are only aggregated: no sort of them and no exchange but that of ten bins
    # (and the one that the table above begins with).
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan and plan.count("Exchange") == 2
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError, match="missing"):
        B.reliability_bins(df.where("c IS NULL"), "c", "ok")


def test_chrf_of_a_batch_equals_counting(spark):
    from collections import Counter

    from marginalia.operators.scoring import overlap_f

    def plain(p, g, order):
        scores = []
        for n in range(1, min(order, len(p), len(g)) + 1):
            a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (p, g))
            scores.append(2 * sum((a & b).values()) / (len(p) + len(g) - 2 * n + 2))
        return sum(scores) / len(scores) if scores else 0.0

    rng = random.Random(9)
    texts = ["", "a", "ab", "aaaa", "é\U0001f600é", "the same text", "x" * 3000] + ["".join(rng.choice("abc é") for _ in range(rng.randrange(60))) for _ in range(80)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(200)]
    got = overlap_f([p for p, _ in pairs], [g for _, g in pairs], 6)
    assert got == pytest.approx([plain(p, g, 6) for p, g in pairs], abs=1e-12)


def test_ranges_of_large_files_are_digested_by_many_tasks(spark, tmp_path):
    from marginalia.sources import ranges

    rng = random.Random(1)
    contents = {"empty": b"", "small": b"abc", "even": rng.randbytes(40), "long": rng.randbytes(10 * 50 + 3)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    df = ranges.range_fingerprint(spark, str(tmp_path), width=10)

    def plain(content, fan):
        level = [hashlib.sha256(content[i : i + 10]).hexdigest() for i in range(0, max(len(content), 1), 10)]
        while len(level) > 1:
            level = [hashlib.sha256(",".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        return level[0]

    got = {r["file"]: (r["sha256"], r["bytes"], r["ranges"]) for r in df.collect()}
    assert got == {n: (plain(c, ranges.FAN_IN), len(c), max(1, -(-len(c) // 10))) for n, c in contents.items()}
    raw = spark.read.format("file_ranges").option("path", str(tmp_path)).option("range", 10).load()
    assert raw.rdd.getNumPartitions() == 1 + 1 + 4 + 51
    whole = {r["file"]: r["sha256"] for r in ranges.range_fingerprint(spark, str(tmp_path)).collect()}
    assert whole == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    ranges.FAN_IN, kept = 4, ranges.FAN_IN
    try:
        deep = {r["file"]: r["sha256"] for r in ranges.range_fingerprint(spark, str(tmp_path), width=10).collect()}
    finally:
        ranges.FAN_IN = kept
    # A file with fewer levels than the deepest one has its top digested once for each level more.
    def levels(content):
        level = [hashlib.sha256(content[i : i + 10]).hexdigest() for i in range(0, max(len(content), 1), 10)]
        for _ in range(3):
            if len(content) > 10:
                level = [hashlib.sha256(",".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
        return level[0]

    assert deep == {n: levels(c) for n, c in contents.items()}


def test_nothing_is_left_where_a_gate_refuses(spark, tmp_path):
    import os

    rows = [(i, " ".join(["w"] * (30 if i % 10 == 0 else 5)), ("train", "val")[i % 2]) for i in range(100)] + [(100, None, "train")]
    df = spark.createDataFrame(rows, "row_id int, text string, split string").repartition(4)
    seen = spark.sparkContext.accumulator(0)
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="11 of 101"):
        sinks.write_within_length(df, path, 10)
    assert os.listdir(tmp_path) == []
    found = sinks.write_within_length(df, path, 10, max_drop_fraction=0.2)
    assert found == {"rows": 101, "long": 11} and spark.read.parquet(path).count() == 90
    with pytest.raises(ValueError, match="every one"):
        sinks.write_within_length(df, path, 1, max_drop_fraction=1.0)
    assert spark.read.parquet(path).count() == 90  # what was there stays
    assert sinks.write_within_length(df.limit(0), str(tmp_path / "none"), 10) == {"rows": 0, "long": 0}

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    once = df.mapInArrow(counted, df.schema)
    with pytest.raises(ValueError, match="test"):
        sinks.sink_splits(once, df.limit(0), str(tmp_path / "splits"), 1, uid="row_id", splits=["train", "val", "test"])
    assert seen.value == 101 and not os.path.exists(tmp_path / "splits" / "processed")
    sinks.sink_splits(once, df.limit(0), str(tmp_path / "splits"), 1, uid="row_id", splits=["train", "val"])
    assert seen.value == 202 and sorted(os.listdir(tmp_path / "splits")) == ["processed", "rejects", "test_strict"]
    assert spark.read.parquet(str(tmp_path / "splits" / "processed")).count() == 101


def test_band_configs_are_data(spark, tmp_path):
    from marginalia.operators import grading as G_
    from marginalia.schemas import BandConfig, read_band_config, write_band_config

    first = BandConfig.of_taxonomy()
    path = str(tmp_path / "bands")
    write_band_config(spark, first, path)
    assert read_band_config(spark, path) == first
    edits = "array<struct<original:string,replacement:string,tag:string,start:int,end:int>>"
    df = spark.createDataFrame([("a b c d", [("a", "x", "sp", 0, 1)]), ("a b c d", [])], f"text string, edits {edits}")
    with pytest.raises(ValueError, match="not calibrated"):
        G_.derive_bands(df, config=first)
    words = " ".join("abcdefghijkl")
    rows = [(words, " ".join(f"[{w}>x:{t}]" if i < n else w for i, w in enumerate(words.split()))) for n in range(1, 12) for t in ("sp", "coll", "unnat")]
    texts = spark.createDataFrame(rows, "text string, correction string")
    with pytest.raises(ValueError, match="erase a band"):
        B.calibrate(texts, first)  # most penalties of either group are zero
    second = first.with_thresholds([0.1, 0.2, 0.3, 0.4])
    assert second.version == 2 and second.calibrated
    write_band_config(spark, second, path)
    assert read_band_config(spark, path) == second
    plain = G_.derive_bands(df, thresholds=second.thresholds)
    assert sorted(map(tuple, G_.derive_bands(df, config=second).collect())) == sorted(map(tuple, plain.collect()))
    # Moving a tag to the other group moves its penalty.
    groups = {"correctness": [t for t in first.groups["correctness"] if t != "sp"], "usage": first.groups["usage"] + ["sp"]}
    moved = BandConfig(3, True, first.weights, groups, second.thresholds)
    (row,) = G_.derive_bands(df, config=moved).where("size(edits) = 1").collect()
    (old,) = plain.where("size(edits) = 1").collect()
    assert (row["grammar"], row["naturalness"]) == (old["naturalness"], old["grammar"]) != (old["grammar"], old["naturalness"])
    for broken in ({"version": 0}, {"thresholds": [1.0, 2.0]}, {"weights": {"sp": 1}}, {"groups": {"usage": []}}):
        held = json.loads(first.to_json()) | broken
        with pytest.raises(ValueError):
            BandConfig.from_json(json.dumps(held))
    with pytest.raises(ValueError, match="has no"):
        BandConfig.from_json('{"version": 1}')


def test_rejects_say_what_was_refused(spark):
    from marginalia.operators import grading as G_

    cases = [
        ("a b", "a [b", 1, "Good.", "malformed_edit", "offset 2"), ("a b", "[a>x:sp] [b>c:zzz]", 1, "Good.", "unknown_tag", "tag zzz"),
        ("a b", "é\\[a [>:sp]", 1, "Good.", "empty_edit", "offset 5"), ("a b", "a c", 1, "Good.", "text_altered", None),
        ("a b", "a b", 9, "Good.", "meaning_range", "meaning 9"), ("a b", "a b", None, "Good.", "bad_type", "meaning"),
        ("a b", "a b", 1, None, "bad_type", "feedback"), ("a b", "a b", 1, " ", "feedback_empty", None),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)] + [(99, "a b", "a b", 1, "Good.")], "i int, text string, correction string, meaning int, feedback string")
    valid, rejects = G_.validate_rows(df)
    assert [r["i"] for r in valid.collect()] == [99] and "reject_detail" not in valid.columns
    assert {r["i"]: (r["reject_reason"], r["reject_detail"]) for r in rejects.collect()} == {i: c[4:] for i, c in enumerate(cases)}


def test_batches_with_an_id_fault_stay_pending(spark):
    specs = [(b, f"{b}{i}") for b in ("ok", "lost", "twice", "odd", "none") for i in range(3)]
    asked = spark.createDataFrame([(b, s, "u", "word", "word", "noun", "d", None, False, False, "p", 1, "few") for b, s in specs], SPEC_COLUMNS)

    def reply(*ids):
        return json.dumps({"sentences": [{"spec_id": i, "text": "a word here"} for i in ids]})

    replies = [("ok", reply("ok0", "ok1", "ok2")), ("lost", reply("lost1")), ("twice", reply("twice0", "twice0", "twice1", "twice2")), ("odd", reply("odd0", "odd1", "odd2", "x"))]
    got = spark.createDataFrame(replies, "batch_uid string, response string")
    assert sorted(r["req_uid"] for r in Q.expand_batches(got, asked).collect()) == ["ok0", "ok1", "ok2"]
    assert sorted(map(tuple, Q.refused_batches(got, asked).collect())) == [
        ("lost", "missing_spec_id", 2), ("odd", "unexpected_spec_id", 1), ("twice", "duplicate_spec_id", 1),
    ]


def test_requests_of_a_refused_batch_are_rows_with_its_fault(spark):
    specs = [(b, f"{b}{i}") for b in ("ok", "lost", "twice", "odd", "none") for i in range(2)]
    asked = spark.createDataFrame([(b, s, "u", "word", "word", "noun", "d", None, False, False, "p", 1, "few") for b, s in specs], SPEC_COLUMNS)
    replies = {"ok": ["ok0", "ok1"], "lost": ["lost1"], "twice": ["twice0", "twice0", "twice1"], "odd": ["odd0", "odd1", "x"]}
    cells = [(b, json.dumps({"sentences": [{"spec_id": i, "text": "a word here"} for i in ids]})) for b, ids in replies.items()]
    got = spark.createDataFrame(cells, "batch_uid string, response string")
    rows = Q.expand_batches(got, asked, refused=True).collect()
    faults = {"ok": None, "lost": "missing_spec_id", "twice": "duplicate_spec_id", "odd": "unexpected_spec_id"}
    want = [(f"{b}{i}", b, fault, None if f"{b}{i}" == "lost0" else "a word here") for b, fault in faults.items() for i in range(2)]
    assert sorted((r["req_uid"], r["batch_uid"], r["reject_reason"], r["text"]) for r in rows) == sorted(want)


SPEC_COLUMNS = "batch_uid string, spec_id string, sense_uid string, target string, target_norm string, pos string, definition string, cefr string, is_multiword boolean, is_placeholder boolean, profile_id string, meaning_req int, error_spec string"


def numbers(report):
    return {(r["section"], r["key"]): r["value"] for r in report.collect()}


def test_generation_report(spark):
    batches = ("same", "short", "lost", "twice", "none", "old")
    specs = [(b, f"{b}{i}", "u", "word", "word", "noun", "d", None, False, False, "p", 1, "few") for b in batches for i in range(3)]
    asked = spark.createDataFrame(specs, SPEC_COLUMNS)

    def reply(text, *ids):
        return json.dumps({"sentences": [{"spec_id": i, "text": text} for i in ids]})

    answers = [
        ("same", reply("a word for you", "same0", "same1", "same2")), ("short", reply("wo", "short0", "short1", "short2")),
        ("lost", reply("a word here", "lost2")), ("twice", reply("a word here", "twice0", "twice0", "twice1", "twice2")),
        ("old", reply("never looked at", "x")),
    ]
    got = spark.createDataFrame(answers, "batch_uid string, response string")
    done = spark.createDataFrame([("old",), ("old",)], "batch_uid string")
    found = numbers(flows.generation_report(got, asked, done))
    # Of nine bigrams three differ and of six trigrams two; the batch that lost its texts scores 1.
    assert found == {
        ("batches", "all"): 2, ("batches_cached", "all"): 1, ("batches_failed", "all"): 3, ("texts", "all"): 3, ("texts_rejected", "all"): 6,
        ("low_diversity_batches", "all"): 1, ("mean_distinct2", "all"): 0.6667, ("mean_distinct3", "all"): 0.6667,
        ("reject_reasons", "too_short"): 3, ("reject_reasons", "missing_spec_id"): 2, ("reject_reasons", "duplicate_spec_id"): 1,
    }
    nothing = numbers(flows.generation_report(got.where("false"), asked.where("false")))
    assert len(nothing) == 8 and set(nothing.values()) == {0}
    unanswered = numbers(flows.generation_report(got.where("false"), asked))
    assert unanswered["batches_failed", "all"] == 6 and unanswered["mean_distinct2", "all"] == 0


def test_generation_report_checks_ids_once_and_moves_each_text_once(spark, monkeypatch):
    calls = []
    whole = Q.response_id_check
    monkeypatch.setattr(Q, "response_id_check", lambda *a: calls.append(1) or whole(*a))
    specs = [(b, f"{b}{i}", "u", "word", "word", "noun", "d", None, False, False, "p", 1, "few") for b in ("ok", "old") for i in range(2)]
    asked = spark.createDataFrame(specs, SPEC_COLUMNS)
    answer = json.dumps({"sentences": [{"spec_id": f"ok{i}", "text": "\u2003a word here \n"} for i in range(2)]})
    got = spark.createDataFrame([("ok", answer), ("old", answer), ("new", answer)], "batch_uid string, response string")
    done = spark.createDataFrame([("old",)], "batch_uid string")
    found = numbers(flows.generation_report(got, asked, done))
    assert len(calls) == 1 and found["reject_reasons", "unexpected_spec_id"] == 1 and found["batches", "all"] == 1
    assert found["texts", "all"] == 2 and found["batches_cached", "all"] == 1 and found["batches_failed", "all"] == 0
    plan = Q.expand_batches(got, asked)._jdf.queryExecution().executedPlan().toString()
    assert "min(text" not in plan


def test_label_report(spark):
    texts = spark.createDataFrame([(f"r{i}", "u", "a b") for i in range(7)], "req_uid string, sense_uid string, text string")

    def reply(correction, meaning=2, feedback="Well done here."):
        return json.dumps({"correction": correction, "meaning": meaning, "feedback": feedback})

    rows = [
        ("r0", 0, reply("a [b>c:sp]")), ("r1", 0, reply("[a>x:other] [b>c:sp]", 4)), ("r2", 0, reply(None, 0)), ("r3", 0, reply("a b", 9)),
        ("r4", 0, "no"), ("r4#p1", 1, reply("a b")), ("r5#p1", 1, reply("a b")), ("r6", 0, reply("a b")),
    ]
    replies = spark.createDataFrame([(*r, "h") for r in rows], "req_uid string, pass_index int, reply string, prompt_hash string")
    before = spark.createDataFrame([("r6",), ("r0#p1",)], "req_uid string")
    found = numbers(flows.label_report(texts, replies, before))
    assert found == {
        ("requests", "all"): 6, ("cached", "all"): 1, ("failed", "all"): 1, ("labelled", "all"): 3, ("rejected", "all"): 2,
        ("null_corrections", "all"): 1, ("validity_rate", "all"): 0.6, ("other_tag_share", "all"): 0.3333, ("middle_band_share", "all"): 0.3333,
        ("reject_reasons", "meaning_range"): 1, ("reject_reasons", "missing_field"): 1, ("meaning_counts", "2"): 1, ("meaning_counts", "4"): 1,
        ("meaning_counts", "0"): 1, ("tag_counts", "sp"): 2, ("tag_counts", "other"): 1,
    }
    second = numbers(flows.label_report(texts, replies, before, pass_index=1))
    assert (second["requests", "all"], second["cached", "all"], second["failed", "all"], second["labelled", "all"]) == (6, 1, 4, 2)
    nothing = numbers(flows.label_report(texts, replies.where("false"), before))
    assert nothing["failed", "all"] == 6 and nothing["validity_rate", "all"] == 0 and len(nothing) == 9


def test_rewards_read_raw_answers(spark):
    gold = spark.createDataFrame([("r", "a b", "a [b>c:sp]", 2, "Well done here.")], "req_uid string, text string, correction string, meaning int, feedback string")
    full = json.dumps({"correction": "a [b>c:sp]", "meaning": 2, "feedback": "Well done here."})
    texts = [full, f"Sure: {full}", "[1]", "null", None, "{", '{"meaning": 2}', json.dumps({"correction": "a [b>c:sp]", "meaning": "2", "feedback": "Well done here."})]
    made = spark.createDataFrame([(i, "r", t) for i, t in enumerate(texts)], "rollout_id int, req_uid string, answer_text string")
    for scope, best in (("correction_meaning", 1.0), ("full_answer", 1.2)):
        got = {r["rollout_id"]: r for r in O.verifiable_reward(made, gold, scope=scope).collect()}
        assert got[0]["total"] == got[0]["normalised"] == pytest.approx(best)
        assert all(got[i]["total"] == 0.0 for i in (1, 2, 3, 4, 5)) and 0 < got[6]["total"] < 1
        assert got[7]["meaning"] == 0.0 and got[7]["format_valid"] == 0.0
    half = O.verifiable_reward(made.where("rollout_id = 0"), gold, weights={"edit_f1": 1.5}).first()
    assert half["total"] == pytest.approx(2.0) and half["normalised"] == pytest.approx(1.0)
