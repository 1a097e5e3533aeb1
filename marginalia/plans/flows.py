"""Whole jobs: building a dataset, and scoring predictions into one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.arrays import with_columns_once
from marginalia.functions.markup import no_edits, parse_markup
from marginalia.operators import calibration, curate, gates, joins, log, requests, scoring
from marginalia.operators.grading import check_rows, derive_bands, ingest_labels
from marginalia.operators.ranking import written
from marginalia.operators.tally import tally
from marginalia.schemas import CEILING_KEYS, BandConfig, literal_rows


def process_dataset(
    texts: DataFrame,
    labels: DataFrame,
    seed: int,
    version: str,
    max_stratum_share: float = 0.15,
    max_reject_rate: float = 0.10,
    group: str = "target_norm",
) -> tuple[DataFrame, DataFrame]:
    """Join, check, cap and split: the rows kept and the rejects. The gates run first."""
    kept, rejects, _ = process_with_report(
        texts, labels, seed, version, max_stratum_share, max_reject_rate, group
    )
    return kept, rejects


def process_with_report(
    texts: DataFrame,
    labels: DataFrame,
    seed: int,
    version: str,
    max_stratum_share: float = 0.15,
    max_reject_rate: float = 0.10,
    group: str = "target_norm",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dataset, its rejects and a report ``(section, key, n)`` on what became of the rows.

    The checked rows are written once, since the gate, the clean rows, the rejects and the
    report all read them.
    """
    joined = joins.join_texts_labels(texts, labels)
    checked = written(check_rows(joined))
    gate = gates.reject_rate_gate(checked, max_reject_rate).first()
    if not gate["passed"]:
        raise ValueError(f"{gate['rejected']} of {gate['rows']} rows failed the checks")
    clean = curate.derive_row_stats(
        derive_bands(checked.where(F.col("reject_reason").isNull()).drop("reject_reason"))
    ).drop("edits")
    capped = curate.cap_strata(
        clean,
        ["meaning", "error_spec"],
        max_stratum_share,
        seed,
        uid="req_uid",
    )
    split = written(curate.group_split(capped, group, seed, version=version))
    crossing = curate.contamination(split).first()["cross_split_text_hashes"]
    if crossing:
        raise ValueError(f"{crossing} texts appear in more than one split")
    reason = F.col("reject_reason")
    stratum = F.concat_ws("|", F.col("meaning").cast("string"), "error_spec")
    report = curate.union_sources(
        tally(
            checked,
            input_rows=F.lit("all"),
            clean_rows=F.when(reason.isNull(), "all"),
            rejected_rows=F.when(reason.isNotNull(), "all"),
            reject_reason=reason,
            stratum_before_cap=F.when(reason.isNull(), stratum),
        ),
        tally(split, stratum_after_cap=stratum, split=F.col("split")),
        tally(curate.strict_test(split), strict_test_rows=F.lit("all")),
        split.sparkSession.createDataFrame(
            [("cross_split_texts", "all", crossing)], "section string, key string, n bigint"
        ),
    )
    return split, checked.where(reason.isNotNull()).drop("edits"), report


def _cells(row: DataFrame) -> DataFrame:
    """The numbers of a one-row table as rows ``(section, key, value)``."""
    return unpivot(row, "").select(F.col("metric").alias("section"), F.lit("all").alias("key"), "value")


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row tables of different columns as one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _counted(counts: DataFrame) -> DataFrame:
    """Rows ``(section, key, n)`` with the count as a double ``value``."""
    return counts.select("section", "key", F.col("n").cast("double").alias("value"))


def generation_report(
    responses: DataFrame, specs: DataFrame, done: DataFrame | None = None, threshold: float = 0.7
) -> DataFrame:
    """What a run of written batches came to, as rows ``(section, key, value)``.

    ``done`` has the ``batch_uid`` of batches that earlier runs finished: they are counted as cached
    and their answers are not looked at again. A batch without an answer or with an id fault has failed.
    The diversity is that of the accepted texts, where a batch that lost all of them scores 1.0;
    both means are 0 if no batch was finished. The faults and the expanded rows are written once; finished
    batches are left out of the faults, one row each, and without these they have no rows.
    """
    batches = written(specs.select("batch_uid").distinct())
    faults = requests.batch_faults(responses, specs)
    every = batches.agg(F.count("batch_uid").alias("n"))
    if done is not None:
        finished = written(done.select("batch_uid").distinct())
        batches = batches.join(finished, "batch_uid", "left_anti")
        faults = faults.join(finished, "batch_uid", "left_anti")
    asked = batches.agg(F.count("batch_uid").alias("asked"))
    faults = written(faults)
    rows = written(requests.expand_batches(responses, specs, faults=faults).select("batch_uid", "text", "reject_reason"))
    refused = requests.refused_batches(responses, specs, faults)
    accepted = F.col("reject_reason").isNull()
    ran = rows.agg(
        F.count_distinct("batch_uid").alias("batches"),
        F.count_if(accepted).alias("texts"),
        F.count_if(~accepted).alias("refused_texts"),
    )
    shares = requests.batch_diversity(rows.where(accepted), "batch_uid", "text", threshold)
    sums = shares.agg(
        F.count("*").alias("measured"),
        F.count_if("collapsed").alias("low_diversity_batches"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("distinct2", "distinct3")],
    )
    faults = refused.groupBy(F.col("batch_fault").alias("key")).agg(F.sum("n").alias("n"))
    reasons = curate.union_sources(
        tally(rows, reject_reasons=F.col("reject_reason")),
        faults.select(F.lit("reject_reasons").alias("section"), "key", "n"),
    )
    one = _beside(every, asked, ran, sums, refused.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("refused_ids")))

    def mean(name: str) -> Column:
        whole = F.col(name) + F.col("batches") - F.col("measured")
        return F.round(F.coalesce(F.try_divide(whole, F.col("batches")), F.lit(0.0)), 4).alias(f"mean_{name}")

    totals = one.select(
        "batches",
        (F.col("n") - F.col("asked")).alias("batches_cached"),
        (F.col("asked") - F.col("batches")).alias("batches_failed"),
        "texts",
        (F.col("refused_texts") + F.col("refused_ids")).alias("texts_rejected"),
        "low_diversity_batches",
        mean("distinct2"),
        mean("distinct3"),
    )
    return _cells(totals).unionByName(_counted(reasons))


def label_report(texts: DataFrame, replies: DataFrame, graded_before: DataFrame, pass_index: int = 0) -> DataFrame:
    """What a grading run came to, as rows ``(section, key, value)``.

    ``texts`` are the requests, ``graded_before`` the log of earlier runs (``req_uid`` with its pass suffix):
    requests in it are cached, and replies to them are not looked at. A request without a reply of this pass has
    failed. The three shares are 0 where nothing was graded. The checked rows are written once.
    """
    pending = log.pending_requests(texts, graded_before, pass_index)
    graded = written(
        ingest_labels(replies.where(F.col("pass_index") == pass_index), pending).select(
            "req_uid", "reject_reason", "meaning", "correction", "tags"
        )
    )
    good = F.col("reject_reason").isNull()
    tags = F.when(good, F.col("tags"))

    def share(part: Column, whole: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)

    labelled, other = F.count_if(good), F.count_if(good & F.array_contains("tags", "other"))
    found = graded.agg(
        F.count_distinct("req_uid").alias("replied"),
        labelled.alias("labelled"),
        F.count_if(~good).alias("rejected"),
        F.count_if(good & F.col("correction").isNull()).alias("null_corrections"),
        share(labelled, F.count("*")).alias("validity_rate"),
        share(other, F.sum(F.size(tags))).alias("other_tag_share"),
        share(F.count_if(good & F.col("meaning").isin(1, 2, 3)), labelled).alias("middle_band_share"),
    )
    one = _beside(texts.agg(F.count("*").alias("every")), pending.agg(F.count("*").alias("requests")), found)
    totals = one.select(
        "requests",
        (F.col("every") - F.col("requests")).alias("cached"),
        (F.col("requests") - F.col("replied")).alias("failed"),
        "labelled",
        "rejected",
        "null_corrections",
        "validity_rate",
        "other_tag_share",
        "middle_band_share",
    )
    counts = tally(graded, reject_reasons=F.col("reject_reason"), meaning_counts=F.when(good, F.col("meaning")), tag_counts=tags)
    return _cells(totals).unionByName(_counted(counts))


def unpivot(row: DataFrame, group: str) -> DataFrame:
    """A one-row table of numbers as rows ``(grp, metric, value)``."""
    numeric = [f.name for f in row.schema if f.dataType.typeName() != "string"]
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in numeric
        ]
    )
    return row.select(F.lit(group).alias("grp"), F.inline(cells))


def keyed(rows: DataFrame, group: str, name: str, key: str) -> DataFrame:
    """The numbers of a table as rows ``(grp, metric, value)``; a metric is called ``name.key.column``."""
    cells = F.array(
        *[
            F.struct(
                F.concat_ws(".", F.lit(name), F.col(key).cast("string"), F.lit(c)).alias("metric"),
                F.col(c).cast("double").alias("value"),
            )
            for c in rows.columns
            if c != key
        ]
    )
    return rows.select(F.lit(group).alias("grp"), F.inline(cells))


def _other(col: str) -> Column:
    tags = F.transform(F.coalesce(F.col(col), no_edits()), lambda e: e["tag"])
    return F.sum(F.size(F.filter(tags, lambda t: t == "other"))) / F.greatest(
        F.sum(F.size(tags)), F.lit(1)
    )


def score_report(
    predictions: DataFrame,
    ceilings: DataFrame,
    bins: int = 10,
    uid: str = "req_uid",
    config: BandConfig | None = None,
) -> DataFrame:
    """Every metric of a prediction table with its reliability and share of the ceiling.

    Beside the headline numbers: each band by itself, the tags of both sides, the confusions, the bins of
    the reliability diagram, and notes, which are rows without a value. A missing ceiling is an error,
    and so is a ``config`` that was not calibrated. The parsed rows are written once, and so are the ceilings.
    """
    if config is not None:
        config.require_calibrated()
    ceilings = written(ceilings)
    absent = sorted(set(CEILING_KEYS.values()) - {r["metric"] for r in ceilings.select("metric").collect()})
    if absent:
        raise ValueError(f"no ceiling for {absent}: numbers without one read as worse than they are")
    parsed = with_columns_once(
        predictions,
        gold_edits=parse_markup(F.col("gold.correction"))["edits"],
        pred_edits=parse_markup(F.col("prediction.correction"))["edits"],
    ).select(
        "*",
        F.col("prediction.meaning").alias("predicted"),
        F.col("gold.meaning").alias("gold_band"),
        F.col("prediction.feedback").alias("pred_feedback"),
        F.col("gold.feedback").alias("gold_feedback"),
    )
    parsed = written(parsed)
    banded = scoring.in_range(parsed, "predicted", "gold_band")
    notes = ["feedback has no verifiable truth: chrf and win rates are weak and are shown as such"]
    parts = [
        unpivot(scoring.meaning_metrics(parsed, "predicted", "gold_band"), "meaning"),
        unpivot(scoring.correction_scores(parsed), "correction"),
        unpivot(scoring.format_metrics(predictions), "format"),
        unpivot(scoring.feedback_chrf(parsed).select("chrf"), "feedback"),
        unpivot(
            parsed.agg(
                _other("pred_edits").alias("other_rate"), _other("gold_edits").alias("gold_other_rate")
            ),
            "taxonomy",
        ),
    ]
    usable, sure = banded.agg(F.count("*"), F.count("meaning_confidence")).first()
    if not usable:
        raise ValueError("nothing to score: no predicted band is in range")
    if usable == sure:
        right = banded.withColumn("_right", F.col("predicted") == F.col("gold_band"))
        found = written(calibration.reliability_bins(right, "meaning_confidence", "_right", bins, uid))
        parts.append(unpivot(calibration.ece(found).select("ece"), "calibration"))
        parts.append(keyed(found, "calibration", "bin", "bin"))
    else:
        notes.append("calibration is left out: not every row that counts has a confidence")
    parts.append(keyed(scoring.per_band_metrics(parsed, "predicted", "gold_band"), "meaning", "band", "band"))
    for side in ("pred", "gold"):
        tags = parsed.select(F.explode(F.transform(f"{side}_edits", lambda e: e["tag"])).alias("tag"))
        parts.append(keyed(tags.groupBy("tag").agg(F.count("*").alias("n")), "taxonomy", f"{side}_tag", "tag"))
    pairs = scoring.tag_confusion(parsed).where(F.col("gold_tag") != F.col("pred_tag"))
    named = pairs.select(F.concat_ws("->", "gold_tag", "pred_tag").alias("pair"), "n")
    parts.append(keyed(named, "correction", "confusion", "pair"))
    said = [("notes", note, None) for note in notes]
    parts.append(literal_rows(parsed.sparkSession, "grp string, metric string, value double", said))
    return gates.ceiling_report(curate.union_sources(*parts), ceilings)
