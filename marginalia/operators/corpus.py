"""Turning an annotated learner corpus into marked-up corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import hashing
from marginalia.functions.arrays import at, bind, each, first_match, running_total, with_columns_once
from marginalia.functions.markup import parse_markup, render_markup
from marginalia.functions.text import n_words, words
from marginalia.operators.curate import cap_strata, dedupe_first, drop_fragments, edit_bucket, row_split
from marginalia.operators.ranking import written
from marginalia.operators.tally import tally
from marginalia.schemas import (
    EDIT,
    ERROR_TYPE_TAGS,
    NO_SPACE_AFTER,
    NO_SPACE_BEFORE,
    SILENT_TYPES,
    literal_map,
)


def joined_tokens(tokens: Column) -> Column:
    """``struct(text, offsets)``: natural spacing, and each token's start plus the end."""

    def glued(t: Column, i: Column) -> Column:
        before = at(tokens, i - 1)
        clitic = F.startswith(t, F.lit("'")) | F.startswith(t, F.lit("n't"))
        return (
            F.when(i == 0, True)
            .when((t != "") & F.contains(F.lit(NO_SPACE_BEFORE), F.substring(t, 1, 1)), True)
            .when(clitic & F.rlike(t, F.lit(r"^(n't|'[\p{L}\p{N}_]{1,2})$")), True)
            .otherwise((before != "") & F.contains(F.lit(NO_SPACE_AFTER), F.substring(before, -1, 1)))
        )

    def place(pieces: Column) -> Column:
        ends = running_total(F.transform(pieces, F.length))
        starts = bind(
            ends,
            lambda e: F.concat(
                each(tokens, lambda t, i: at(e, i + 1) - F.length(t)),
                F.array(F.element_at(e, -1)),
            ),
        )
        return F.struct(F.array_join(pieces, "").alias("text"), starts.alias("offsets"))

    pieces = each(tokens, lambda t, i: F.when(glued(t, i), t).otherwise(F.concat(F.lit(" "), t)))
    return bind(pieces, place)


def joined_text(value: Column) -> Column:
    """A blank-separated token string with natural spacing."""
    return bind(F.split(value, " "), lambda t: joined_tokens(t)["text"])


def detokenise(df: DataFrame) -> DataFrame:
    """Add ``text`` and token ``offsets`` for a ``tokens`` array."""
    out = with_columns_once(df, _j=joined_tokens(F.col("tokens")))
    return out.select(*df.columns, F.col("_j.text").alias("text"), F.col("_j.offsets").alias("offsets"))


def _typed(a: Column, tokens: Column, mapping: dict[str, str]) -> Column:
    """One annotation with its replacement, tag and the reason it spoils the sentence."""
    silent = a["type"].isin(SILENT_TYPES)
    inside = (a["start"] >= 0) & (a["start"] <= a["end"]) & (a["end"] <= F.size(tokens))
    held = F.when(inside, F.slice(tokens, a["start"] + 1, a["end"] - a["start"]))
    replacement = F.when(a["correction"].isin("", "-NONE-"), "").otherwise(
        joined_text(a["correction"])
    )
    key = F.when(F.contains(a["type"], F.lit(":")), F.regexp_replace(a["type"], "^[^:]*:", ""))
    key = F.coalesce(key, a["type"])

    def tag(r: Column) -> Column:
        long = (F.size(words(F.array_join(held, " "))) > 1) | (F.size(words(r)) > 1)
        return F.when(key == "OTHER", F.when(long, "unnat").otherwise("word")).otherwise(
            F.try_element_at(literal_map(mapping), key)
        )

    def described(r: Column) -> Column:
        found = tag(r)
        fault = (
            F.when(silent, None)
            .when(~inside, "span_out_of_range")
            .when(found.isNull(), F.concat(F.lit("unmapped_type:"), a["type"]))
        )
        return F.struct(
            a["start"].alias("start"), a["end"].alias("end"), r.alias("replacement"),
            found.alias("tag"), a["type"].alias("type"), silent.alias("silent"),
            fault.alias("fault"),
        )

    return bind(replacement, described)


def map_error_types(
    df: DataFrame, mapping: dict[str, str] | None = None, coder: str = "0"
) -> DataFrame:
    """Add ``typed``: one annotator's edits with tags; ``type_fault`` drops the sentence.

    Silent types drop only the edit. ``skipped`` and ``other_split`` list what was met before
    the first fault.
    """
    mine = F.filter("annotations", lambda a: a["coder"] == coder)
    typed = F.transform(mine, lambda a: _typed(a, F.col("tokens"), mapping or ERROR_TYPE_TAGS))

    def summary(t: Column) -> Column:
        def faulty(x: Column) -> Column:
            return x["fault"].isNotNull()

        until = F.coalesce(
            first_match(
                each(t, lambda x, i: F.when(faulty(x), i)), lambda i: i.isNotNull()
            ),
            F.size(t),
        )
        met = F.slice(t, F.lit(1), until)
        skipped = F.transform(F.filter(met, lambda x: x["silent"]), lambda x: x["type"])
        other = F.filter(met, lambda x: ~x["silent"] & F.endswith(x["type"], F.lit("OTHER")))
        return F.struct(
            F.sort_array(
                F.transform(
                    F.filter(t, lambda x: ~x["silent"]),
                    lambda x: F.struct(x["start"], x["end"], x["replacement"], x["tag"]),
                )
            ).alias("typed"),
            first_match(t, faulty)["fault"].alias("type_fault"),
            skipped.alias("skipped"),
            F.transform(other, lambda x: x["tag"]).alias("other_split"),
        )

    out = with_columns_once(df, _t=bind(typed, summary))
    return out.select(*df.columns, "_t.*")


def convert_corpus(
    blocks: DataFrame, coder: str = "0", mapping: dict[str, str] | None = None
) -> DataFrame:
    """Corpus sentences as ``(text, correction, tags, ...)`` with a ``drop_reason``.

    A correction must read back as exactly the sentence it was made from; otherwise the
    sentence is dropped, not repaired.
    """
    ready = detokenise(map_error_types(blocks, mapping, coder))
    text, offsets, tokens = F.col("text"), F.col("offsets"), F.col("tokens")

    def edit(e: Column) -> Column:
        insert = e["start"] == e["end"]
        begin = at(offsets, e["start"])
        last = e["end"] - 1
        finish = F.when(insert, begin).otherwise(at(offsets, last) + F.length(at(tokens, last)))
        return F.struct(
            F.substring(text, begin + 1, finish - begin).alias("original"),
            e["replacement"], e["tag"], begin.alias("start"), finish.alias("end"),
        )

    early = each(F.col("typed"), lambda e, i: (i > 0) & (e["start"] < at(F.col("typed"), i - 1)["end"]))
    ready = ready.withColumn("_clash", F.exists(early, lambda x: x))
    fit = F.col("type_fault").isNull() & ~F.col("_clash")
    edits = F.transform("typed", edit).cast(f"array<{EDIT.simpleString()}>")
    made = with_columns_once(
        ready,
        correction=F.when(fit, bind(edits, lambda es: render_markup(text, es))),
    )
    made = with_columns_once(made, _back=parse_markup(F.col("correction")))
    reason = (
        F.when(F.col("type_fault").isNotNull(), F.col("type_fault"))
        .when(F.col("_clash"), "overlapping_edits")
        .when(F.col("correction").isNull(), "render_error")
        .when(
            F.col("_back.error").isNotNull(), F.concat(F.lit("reparse:"), F.col("_back.error"))
        )
        .when(F.col("_back.text") != text, "roundtrip_mismatch")
    )
    tags = F.transform("typed", lambda e: e["tag"])
    keep = [c for c in blocks.columns if c not in ("tokens", "annotations")]
    rows = made.select(
        *keep,
        "text",
        "correction",
        F.substring(
            hashing.digest(F.concat(text, F.lit("\0"), F.col("correction"))), 1, 16
        ).alias("row_uid"),
        tags.alias("all_tags"),
        F.array_sort(F.array_distinct(tags)).alias("tags"),
        F.size(tags).alias("n_edits"),
        n_words(text).alias("n_words"),
        "skipped",
        "other_split",
        reason.alias("drop_reason"),
    )
    return edit_bucket(rows)


def import_stats(conv: DataFrame, min_conversion_rate: float = 0.95) -> DataFrame:
    """Import counters as rows ``(section, key, n)``; below the floor this is an error.

    The counters are written once, so that the floor does not convert the corpus a second time.
    """
    kept = F.col("drop_reason").isNull()
    counted = tally(
        conv,
        sentences=F.lit("all"),
        converted=F.when(kept, "all"),
        dropped=F.col("drop_reason"),
        skipped_edits=F.col("skipped"),
        other_split=F.col("other_split"),
        tags=F.when(kept, F.col("all_tags")),
        buckets=F.when(kept, F.col("edit_bucket")),
        cefr=F.when(kept, F.col("cefr")),
    )
    counted = written(counted)
    base = {r["section"]: r["n"] for r in
            counted.where(F.col("section").isin("sentences", "converted")).collect()}
    rate = base.get("converted", 0) / max(base.get("sentences", 0), 1)
    if rate < min_conversion_rate:
        raise ValueError(f"converted {rate:.2%} of the sentences, below {min_conversion_rate:.0%}")
    return counted


def import_corpus(
    blocks: DataFrame,
    seed: int,
    max_stratum_share: float = 0.15,
    val_share: float = 0.05,
    min_words: int = 3,
    min_conversion_rate: float = 0.95,
) -> DataFrame:
    """Convert, drop duplicates, drop fragments, cap the edit buckets, split."""
    return import_with_report(blocks, seed, max_stratum_share, val_share, min_words, min_conversion_rate)[0]


def import_with_report(
    blocks: DataFrame,
    seed: int,
    max_stratum_share: float = 0.15,
    val_share: float = 0.05,
    min_words: int = 3,
    min_conversion_rate: float = 0.95,
) -> tuple[DataFrame, DataFrame]:
    """The imported rows and a report ``(section, key, value)`` on what became of the sentences.

    Too low a share of converted sentences is an error, and so is an import that leaves nothing
    or no row of one of the splits. Of sentences with the same content the first by source and
    row hash stays. Conversion is done once and written; so are the rows that are kept, without
    the columns that only the report needs.
    """
    conv = written(convert_corpus(blocks))
    ok = conv.where(F.col("drop_reason").isNull())
    facts = conv.agg(
        F.count("*").alias("sentences"),
        F.count_if(F.col("drop_reason").isNull()).alias("converted"),
        F.count_distinct(F.when(F.col("drop_reason").isNull(), F.col("row_uid"))).alias("different"),
    ).first()
    rate = facts["converted"] / max(facts["sentences"], 1)
    if rate < min_conversion_rate:
        raise ValueError(f"converted {rate:.2%} of the sentences, below {min_conversion_rate:.0%}")
    rows = ok.select(
        "row_uid", "text", "correction", "tags", "n_edits", "n_words", "cefr", "edit_bucket",
        "source",
    )
    kept = drop_fragments(dedupe_first(rows, "row_uid", "source"), min_words)
    whole = kept.count()
    split = written(row_split(cap_strata(kept, ["edit_bucket"], max_stratum_share, seed), "row_uid", seed, val_share))
    parts = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if not parts:
        raise ValueError("the import leaves no rows")
    if min(parts.get("train", 0), parts.get("val", 0)) == 0:
        raise ValueError(f"the import leaves a split empty: {parts}")
    out = sum(parts.values())
    numbers = {
        ("sentences", "all"): facts["sentences"],
        ("converted", "all"): facts["converted"],
        ("conversion_rate", "all"): rate,
        ("duplicates_removed", "all"): facts["converted"] - facts["different"],
        ("fragments_removed", "all"): facts["different"] - whole,
        ("capped_out", "all"): whole - out,
        **{("split", name): n for name, n in parts.items()},
    }
    counted = tally(
        conv,
        dropped=F.col("drop_reason"),
        skipped_edits=F.col("skipped"),
        tags=F.when(F.col("drop_reason").isNull(), F.col("all_tags")),
    )
    report = blocks.sparkSession.createDataFrame(
        [(*k, float(v)) for k, v in numbers.items()], "section string, key string, value double"
    ).unionByName(counted.select("section", "key", F.col("n").cast("double").alias("value")))
    tags = F.when(F.col("section") == "tags", F.col("value"))
    share = counted.withColumn("value", F.col("n").cast("double")).agg(
        F.coalesce(F.sum(F.when(F.col("key") == "other", tags)) / F.sum(tags), F.lit(0.0)).alias("value")
    )
    return split, report.unionByName(share.select(F.lit("other_tag_share").alias("section"), F.lit("all").alias("key"), "value"))
