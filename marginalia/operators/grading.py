"""Reading, checking and grading corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.arrays import (
    at,
    bind,
    each,
    first_match,
    running_total,
    with_columns_once,
)
from marginalia.functions.markup import (
    band_of,
    corrected_text,
    parse_markup,
    penalty,
    render_markup,
    source_text,
)
from marginalia.functions.text import multi_sentence, n_words, strip
from marginalia.operators.log import request_of
from marginalia.operators.ranking import written
from marginalia.schemas import GROUPS, LABELS, MAX_BAND, MIN_BAND, BandConfig


def parse_corrections(df: DataFrame, col: str = "correction") -> DataFrame:
    """Add ``parsed_text``, ``edits`` and ``parse_error``."""
    return with_columns_once(df, _p=parse_markup(F.col(col))).select(
        *df.columns,
        F.col("_p.text").alias("parsed_text"),
        F.col("_p.edits").alias("edits"),
        F.col("_p.error").alias("parse_error"),
    )


def render_corrections(df: DataFrame) -> DataFrame:
    """Add the markup of ``text`` and ``edits``; ``render_error`` where a span does not fit."""
    out = df.withColumn("correction", render_markup(F.col("text"), F.col("edits")))
    return out.withColumn("render_error", F.col("correction").isNull())


def strip_corrections(df: DataFrame, col: str = "correction") -> DataFrame:
    return df.withColumn("source_text", source_text(F.col(col)))


def apply_corrections(df: DataFrame, col: str = "correction") -> DataFrame:
    return df.withColumn("corrected_text", corrected_text(F.col(col)))


def check_rows(df: DataFrame, detail: bool = False) -> DataFrame:
    """Add ``edits`` and ``reject_reason`` (null when all six checks pass).

    With ``detail`` also ``reject_detail``: the offset of broken markup, the unknown tag, the field or
    the value that was refused.

    Needs ``text, correction, meaning, feedback``. Rows that come from JSON replies also
    carry ``payload_keys`` and the ``*_type`` of each field, so that a missing field and a
    field of the wrong type stay apart from a null correction.
    """
    has = set(df.columns)
    parsed = with_columns_once(df, _p=parse_markup(F.col("correction")))
    feedback = strip(F.col("feedback"))
    none = F.lit(None).cast("string")
    reason = F.struct(none.alias("reject_reason"), none.alias("reject_detail"))

    def failing(test: Column, code: str | Column, rest: Column, detail: str | Column | None = None) -> Column:
        said = [none if x is None else x if isinstance(x, Column) else F.lit(x) for x in (code, detail)]
        return F.when(test, F.struct(said[0].alias("reject_reason"), said[1].alias("reject_detail"))).otherwise(rest)

    # Built from the last check to the first, so the first one that fails decides.
    reason = failing(multi_sentence(feedback), "feedback_multi_sentence", reason)
    reason = failing(feedback == "", "feedback_empty", reason)
    bad_feedback = F.col("feedback").isNull()
    if "feedback_type" in has:
        bad_feedback = bad_feedback | ~F.col("feedback_type").eqNullSafe(F.lit("string"))
    reason = failing(bad_feedback, "bad_type", reason, "feedback")
    out_of_range = ~F.col("meaning").between(MIN_BAND, MAX_BAND)
    bad_meaning = F.col("meaning").isNull()
    if "meaning_type" in has:
        out_of_range = out_of_range | F.col("meaning_type").eqNullSafe(F.lit("long_int"))
        bad_meaning = ~F.coalesce(F.col("meaning_type").isin("int", "long_int"), F.lit(False))
    reason = failing(out_of_range, "meaning_range", reason, F.concat(F.lit("meaning "), F.col("meaning").cast("string")))
    reason = failing(bad_meaning, "bad_type", reason, "meaning")
    altered = F.col("correction").isNotNull() & (F.col("_p.text") != F.col("text"))
    reason = failing(altered, "text_altered", reason)
    reason = failing(F.col("_p.error").isNotNull(), F.col("_p.error"), reason, F.col("_p.detail"))
    if "correction_type" in has:
        reason = failing(~F.col("correction_type").isin("string", "null"), "bad_type", reason, "correction")
    if "payload_keys" in has:
        present = F.array_contains
        for field in ("feedback", "meaning", "correction"):
            absent = ~F.coalesce(present("payload_keys", field), F.lit(False))
            reason = failing(absent, "missing_field", reason, field)
    checked = parsed.select("*", F.inline(F.array(reason)))
    # A valid row carries its feedback trimmed; a refused one keeps what it was refused for.
    trimmed = F.when(F.col("reject_reason").isNull(), feedback).otherwise(F.col("feedback"))
    return checked.select(
        *[trimmed.alias(c) if c == "feedback" else F.col(c) for c in df.columns],
        F.when(F.col("_p.error").isNull(), F.col("_p.edits")).alias("edits"),
        "reject_reason",
        *(["reject_detail"] if detail else []),
    )


def validate_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (with ``edits``) and rejects (with ``reject_reason`` and ``reject_detail``).

    The checked rows are written once, as both sides read them.
    """
    checked = written(check_rows(df, detail=True))
    valid = checked.where(F.col("reject_reason").isNull()).drop("reject_reason", "reject_detail")
    return valid, checked.where(F.col("reject_reason").isNotNull()).drop("edits")


def validate_corrections(df: DataFrame) -> DataFrame:
    """The correction-only checks: add ``correction_fault``, null when they pass."""
    parsed = with_columns_once(df, _p=parse_markup(F.col("correction")))
    fault = F.when(F.col("_p.error").isNotNull(), F.col("_p.error")).when(
        F.col("_p.text") != F.col("text"), "strip_mismatch"
    )
    if "correction_type" in df.columns:
        wrong = ~F.col("correction_type").isin("string", "null")
        fault = F.when(wrong, "correction_type").otherwise(fault)
    return parsed.select(*df.columns, fault.alias("correction_fault"))


def derive_bands(
    df: DataFrame,
    weights: dict[str, int] | None = None,
    thresholds: list[float] | None = None,
    config: BandConfig | None = None,
) -> DataFrame:
    """Add ``grammar`` and ``naturalness`` from ``edits`` and ``text``.

    Null edits mean a sentence beyond correction and give the lowest band, while an empty
    array is a clean sentence and gives the highest. A ``config`` decides about weights, groups and
    cut points, and has to be calibrated.
    """
    words = n_words(F.col("text"))
    members = None
    if config is not None:
        config.require_calibrated()
        weights, thresholds, members = config.weights, config.thresholds, config.groups

    def band(group: str) -> Column:
        value = penalty(F.col("edits"), words, group, weights, members)
        graded = bind(value, lambda v: band_of(v, thresholds))
        return F.when(F.col("edits").isNull(), MIN_BAND).otherwise(graded).cast("int")

    return df.withColumn("grammar", band("correctness")).withColumn("naturalness", band("usage"))


def group_penalties(
    df: DataFrame, weights: dict[str, int] | None = None, config: BandConfig | None = None
) -> DataFrame:
    """Rows ``(..., grp, penalty)`` for every parseable, non-null correction.

    A ``config`` decides about weights and groups; it need not be calibrated, as penalties are what
    its cut points are taken from.
    """
    members = None
    if config is not None:
        weights, members = config.weights, config.groups
    parsed = with_columns_once(df, _p=parse_markup(F.col("correction"))).where(
        F.col("_p").isNotNull() & F.col("_p.error").isNull()
    )
    words = n_words(F.col("text"))
    both = F.array(
        *[
            F.struct(
                F.lit(g).alias("grp"),
                penalty(F.col("_p.edits"), words, g, weights, members).alias("penalty"),
            )
            for g in GROUPS
        ]
    )
    return parsed.select(*df.columns, F.inline(both))


def _first_object(reply: Column) -> Column:
    """The first balanced ``{...}`` of a reply, skipping braces inside JSON strings.

    The reply is cut into strings, braces and the text between them; the depth after each
    brace is a running sum over those tokens.
    """
    pattern = F.lit(r'(?s)([^"{}]*+)("(?:[^"\\]++|\\.)*+"?+|[{}])')
    cut = F.struct(
        F.regexp_extract_all(reply, pattern, F.lit(1)).alias("gap"),
        F.regexp_extract_all(reply, pattern, F.lit(2)).alias("tok"),
    )

    def scan(s: Column) -> Column:
        step = F.transform(
            s["tok"], lambda t: F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        )
        ends = running_total(each(s["tok"], lambda t, i: F.length(at(s["gap"], i)) + F.length(t)))

        def pick(m: Column) -> Column:
            opened = first_match(
                F.sequence(F.lit(0), F.size(s["tok"]) - 1),
                lambda i: (at(s["tok"], i) == "{") & (at(m["depth"], i) == 0),
            )

            def close(o: Column) -> Column:
                closed = first_match(
                    F.sequence(o, F.size(s["tok"]) - 1),
                    lambda i: (at(s["tok"], i) == "}") & (at(m["depth"], i + 1) == 0),
                )
                begin = at(m["ends"], o + 1) - 1
                return F.substring(reply, begin + 1, at(m["ends"], closed + 1) - begin)

            return F.when(opened.isNotNull(), bind(opened, close))

        marks = F.struct(running_total(step).alias("depth"), ends.alias("ends"))
        return F.when(F.size(s["tok"]) > 0, bind(marks, pick))

    return bind(cut, scan)


def parse_responses(df: DataFrame, col: str = "reply") -> DataFrame:
    """Read the first JSON object of each reply into the three answer fields.

    Adds ``payload_keys`` (null when there is no object), ``correction``, ``meaning``,
    ``feedback`` and the ``*_type`` of each: string, int, long_int (a whole number beyond a
    bigint, which leaves the value null), null or other. Of a key given twice the last value
    counts, and a number that is none (NaN, Infinity) is of type other.
    """
    body = with_columns_once(df, _o=_first_object(F.col(col)))
    found = with_columns_once(
        body,
        _v=F.from_json("_o", "correction variant, meaning variant, feedback variant"),
        _k=F.map_keys(F.from_json("_o", "map<string,string>")),
    )

    def part(field: str) -> Column:
        return F.when(F.col("_k").isNotNull(), F.col(f"_v.{field}"))

    kinds = {}
    for field in ("correction", "meaning", "feedback"):
        kind = F.schema_of_variant(part(field))
        # A variant drops a zero fraction, so only a decimal too long for a bigint is whole.
        kinds[field] = (
            F.when(kind == "STRING", "string")
            .when(kind == "BIGINT", "int")
            .when(F.rlike(kind, F.lit(r"^DECIMAL\((19|[2-9]\d),0\)$")), "long_int")
            .when(kind == "VOID", "null")
            .when(kind.isNotNull(), "other")
        )

    def text_of(field: str) -> Column:
        value = F.try_variant_get(part(field), "$", "string")
        return F.when(kinds[field] == "string", value)

    keys = F.array_distinct("_k")
    return found.select(
        *[c for c in df.columns if c not in ("correction", "meaning", "feedback")],
        keys.alias("payload_keys"),
        text_of("correction").alias("correction"),
        F.when(kinds["meaning"] == "int", F.try_variant_get(part("meaning"), "$", "bigint")).alias("meaning"),
        text_of("feedback").alias("feedback"),
        *[kinds[f].alias(f"{f}_type") for f in kinds],
    )


def ingest_labels(
    replies: DataFrame,
    texts: DataFrame,
    weights: dict[str, int] | None = None,
    thresholds: list[float] | None = None,
) -> DataFrame:
    """Graded replies to label rows, with a ``reject_reason`` for the refused ones.

    ``replies`` has the log key ``req_uid`` (with a pass suffix), ``reply``, ``pass_index``
    and ``prompt_hash``; the request id is restored from the log key.
    """
    named = replies.withColumn("req_uid", request_of(F.col("req_uid")))
    asked = named.join(texts.select("req_uid", "sense_uid", "text"), "req_uid", "inner")
    checked = check_rows(parse_responses(asked))
    graded = derive_bands(checked, weights, thresholds)
    edits = F.coalesce(F.col("edits"), F.array().cast(checked.schema["edits"].dataType))
    rows = (
        graded.withColumn("n_edits", F.size(edits))
        .withColumn("n_words", n_words(F.col("text")))
        .withColumn("tags", F.array_sort(F.array_distinct(F.transform(edits, lambda e: e["tag"]))))
        .withColumn("feedback", strip(F.col("feedback")))
        .withColumn("meaning", F.when(F.col("reject_reason").isNull(), F.col("meaning")))
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in LABELS], "reject_reason")
