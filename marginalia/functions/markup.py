r"""Inline corrections ``[original>replacement:tag]`` as column expressions.

All of this runs inside the row: a correction is cut into segments by one regular expression,
and each segment looks only at its neighbours. Quantifiers are possessive so that long texts
neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrays import at, bind, each, first_match, running_total
from marginalia.functions.text import says_null, strip, strip_ends
from marginalia.schemas import (
    EDIT,
    MAX_BAND,
    TAGS,
    THRESHOLDS,
    USAGE_TAGS,
    WEIGHTS,
    literal_map,
)

EDIT_PATTERN = (
    r"\[((?:[^\[\]>\\]++|\\[\[\]]|\\)*+)>((?:[^\[\]:\\]++|\\[\[\]]|\\)*+):([a-z]+)\]"
)
SEGMENT = EDIT_PATTERN + r"|[^\[\\]++|\\[\[\]]|\\|\["
# The same without escapes: an edit that has no fault, and an insert with the blank it swallows or trims.
SOUND_EDIT = rf"\[(?!>:)([^\[\]>\\]*+)>[^\[\]:\\]*+:(?:{'|'.join(TAGS)})\]"
INSERT = r"(\[>[^\[\]:\\]*+:[a-z]++\])"
BLANK_AFTER = r"(\[(?<![^ ]\[)>[^\[\]:\\]*+:[a-z]++\]) "
PLAIN_EDIT = r"\[[^\[\]>]*+>([^\[\]:]*+):[a-z]++\]"
BLANK_BEFORE = " " + INSERT + r"\z"


def no_edits() -> Column:
    return F.array().cast(f"array<{EDIT.simpleString()}>")


def unescape(raw: Column) -> Column:
    out = F.replace(raw, F.lit("\\["), F.lit("["))
    return F.replace(out, F.lit("\\]"), F.lit("]"))


def escape(raw: Column) -> Column:
    out = F.replace(raw, F.lit("["), F.lit("\\["))
    return F.replace(out, F.lit("]"), F.lit("\\]"))


def parse_markup(correction: Column) -> Column:
    """``struct(text, edits, error, detail)``; null for a null correction, text null on an error.

    ``detail`` says where the first fault is, ``offset N`` in the correction, or names an unknown tag.
    """
    groups = F.struct(
        *[
            F.regexp_extract_all(correction, F.lit(SEGMENT), F.lit(g)).alias(name)
            for g, name in enumerate(["raw", "old", "new", "tag"])
        ]
    )
    no_markup = F.struct(
        unescape(correction).alias("text"),
        no_edits().alias("edits"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("detail"),
    )
    return (
        F.when(correction.isNull(), None)
        .when(~F.contains(correction, F.lit("[")), no_markup)
        .otherwise(bind(_drawn_in(correction), lambda drawn: _plain(correction, drawn, bind(groups, _assemble))))
    )


def _drawn_in(correction: Column) -> Column:
    """A correction without the blanks that go with its inserts; null where an edit or its blank needs a closer look.

    That is where something is escaped, and where an insert touches another edit, so that the blank
    before it is not the one in front of its bracket.
    """
    close = F.contains(correction, F.lit("\\")) | F.contains(correction, F.lit("]["))

    def trimmed(c: Column) -> Column:
        touching = F.rlike(c, F.lit(r"\]" + INSERT + r"\z"))
        return F.when(~F.endswith(correction, F.lit("]")), c).when(~touching, F.regexp_replace(c, BLANK_BEFORE, "$1"))

    swallowed = bind(F.regexp_replace(correction, BLANK_AFTER, "$1"), trimmed)
    return F.when(~F.contains(correction, F.lit("[>")) & ~close, correction).when(~close, swallowed)


def _plain(correction: Column, drawn: Column, closer: Column) -> Column:
    """``parse_markup`` of a correction from its drawn-in form, or ``closer`` where that will not do.

    Nothing is escaped here and each bracket opens an edit without a fault, so the parts between
    opening brackets are an edit and the text behind it: ``old>new:tag]text``.
    """

    def part(x: Column) -> Column:
        inside = F.substring_index(x, "]", 1)
        return bind(
            F.struct(
                F.length(x).alias("all"), inside.alias("inside"),
                F.substring_index(inside, ">", 1).alias("old"), F.substring_index(inside, ":", -1).alias("tag"),
            ),
            lambda s: bind(
                F.struct(F.length(s["inside"]).alias("inside"), F.length(s["old"]).alias("old"), F.length(s["tag"]).alias("tag")),
                lambda n: F.struct(
                    s["old"].alias("old"),
                    F.substring(s["inside"], n["old"] + 2, n["inside"] - n["old"] - n["tag"] - 2).alias("new"),
                    s["tag"].alias("tag"), n["old"].alias("length"), (n["old"] + s["all"] - n["inside"] - 1).alias("step"),
                ),
            ),
        )

    def placed(pieces: Column) -> Column:
        def edit(s: Column, i: Column, first: Column, ends: Column) -> Column:
            start = first + at(ends, i)
            return F.struct(
                s["old"].alias("original"), s["new"].alias("replacement"), s["tag"].alias("tag"),
                start.alias("start"), (start + s["length"]).alias("end"),
            )

        def with_steps(parts: Column) -> Column:
            steps = running_total(F.transform(parts, lambda s: s["step"]))
            return bind(
                F.struct(F.length(at(pieces, F.lit(0))).alias("first"), steps.alias("ends")),
                lambda o: each(parts, lambda s, i: edit(s, i, o["first"], o["ends"])),
            )

        return bind(F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), part), with_steps)

    def sound(text: Column) -> Column:
        found = F.struct(
            text.alias("text"),
            bind(F.split(drawn, r"\["), placed).cast(f"array<{EDIT.simpleString()}>").alias("edits"),
            F.lit(None).cast("string").alias("error"),
            F.lit(None).cast("string").alias("detail"),
        )
        return F.when(F.contains(text, F.lit("[")), closer).otherwise(found)

    return F.when(drawn.isNull(), closer).otherwise(bind(F.regexp_replace(drawn, SOUND_EDIT, "$1"), sound))


def _assemble(g: Column) -> Column:
    def segment(x: Column, i: Column) -> Column:
        old, new, tag = at(g["old"], i), at(g["new"], i), at(g["tag"], i)
        is_edit = tag != ""
        fault = (
            F.when(x == "[", "malformed_edit")
            .when(is_edit & ~tag.isin(TAGS), "unknown_tag")
            .when(is_edit & (old == "") & (new == ""), "empty_edit")
        )
        return F.struct(
            F.when(is_edit, old).otherwise(x).alias("shown"),
            new.alias("new"),
            tag.alias("tag"),
            (is_edit & (old == "")).alias("insert"),
            fault.alias("fault"),
        )

    def checked(segs: Column) -> Column:
        bad = first_match(segs, lambda s: s["fault"].isNotNull())["fault"]

        def where(k: Column) -> Column:
            before = F.length(F.array_join(F.slice(g["raw"], F.lit(1), k), ""))
            return F.when(bad == "unknown_tag", F.concat(F.lit("tag "), at(g["tag"], k))).otherwise(
                F.concat(F.lit("offset "), before.cast("string"))
            )

        faulty = first_match(each(segs, lambda s, i: F.when(s["fault"].isNotNull(), i)), lambda i: i.isNotNull())
        failed = F.struct(
            F.lit(None).cast("string").alias("text"), no_edits().alias("edits"), bad.alias("error"),
            bind(faulty, where).alias("detail"),
        )
        return F.when(bad.isNotNull(), failed).otherwise(
            bind(each(segs, lambda s, i: _piece(segs, s, i)), lambda p: _finish(segs, p))
        )

    return bind(each(g["raw"], segment), checked)


def _after_blank(segs: Column, i: Column) -> Column:
    """Is the text before the insert at ``i`` empty or ending in a blank?

    The neighbour decides unless it is an insert too; then the last segment that shows text
    does. A blank taken away by an earlier insert was itself preceded by one.
    """
    before = at(segs, i - 1)
    earlier = F.filter(F.slice(segs, F.lit(1), i), lambda s: ~s["insert"])
    last = F.try_element_at(earlier, F.lit(-1))["shown"]
    return (
        F.when(i == 0, True)
        .when(~before["insert"], F.endswith(before["shown"], F.lit(" ")))
        .otherwise(F.coalesce(F.endswith(last, F.lit(" ")), F.lit(True)))
    )


def _piece(segs: Column, s: Column, i: Column) -> Column:
    """What a segment adds to the text; a blank after a mid-sentence insert goes with it."""
    blank = (s["tag"] == "") & F.startswith(s["shown"], F.lit(" "))
    swallowed = (i > 0) & blank & at(segs, i - 1)["insert"] & _after_blank(segs, i - 1)
    return unescape(F.when(swallowed, F.substring(s["shown"], 2, 1 << 30)).otherwise(s["shown"]))


def _finish(segs: Column, pieces: Column) -> Column:
    last = F.size(pieces) - 1
    parts = F.struct(
        F.array_join(pieces, "").alias("joined"),
        running_total(F.transform(pieces, F.length)).alias("at"),
    )

    def placed(p: Column) -> Column:
        trimmed = at(segs, last)["insert"] & F.endswith(p["joined"], F.lit(" "))
        cut = F.substring(p["joined"], F.lit(1), F.length(p["joined"]) - 1)

        def edit(s: Column, i: Column) -> Column:
            back = F.when(trimmed & (i == last), 1).otherwise(0)
            return F.struct(
                at(pieces, i).alias("original"),
                unescape(s["new"]).alias("replacement"),
                s["tag"].alias("tag"),
                (at(p["at"], i) - back).alias("start"),
                (at(p["at"], i + 1) - back).alias("end"),
            )

        edits = F.filter(each(segs, edit), lambda e: e["tag"] != "")
        return F.struct(
            F.when(trimmed, cut).otherwise(p["joined"]).alias("text"),
            edits.cast(f"array<{EDIT.simpleString()}>").alias("edits"),
            F.lit(None).cast("string").alias("error"),
            F.lit(None).cast("string").alias("detail"),
        )

    return bind(parts, placed)


def render_markup(text: Column, edits: Column) -> Column:
    """Markup for a text and its edits; null when a span is out of order or does not fit."""
    ordered = F.sort_array(
        each(
            edits,
            lambda e, i: F.struct(
                e["start"].alias("start"),
                e["end"].alias("end"),
                i.alias("i"),
                e["original"].alias("original"),
                e["replacement"].alias("replacement"),
                e["tag"].alias("tag"),
            ),
        )
    )

    def build(es: Column) -> Column:
        def cursor(i: Column) -> Column:
            return F.when(i == 0, 0).otherwise(at(es, i - 1)["end"])

        def part(e: Column, i: Column, n: Column) -> Column:
            """What an edit adds, with the text before it; the text is looked into once for both."""
            skipped = e["start"] - cursor(i)

            def shown(chunk: Column) -> Column:
                held = F.substring(chunk, skipped + 1, e["end"] - e["start"])
                misfit = (skipped < 0) | (e["end"] < e["start"]) | (e["end"] > n) | (held != e["original"])
                token = F.concat(
                    F.lit("["), escape(e["original"]), F.lit(">"), escape(e["replacement"]),
                    F.lit(":"), e["tag"], F.lit("]"),
                )
                placed = (
                    F.when(e["original"] != "", token)
                    .when(e["start"] == n, F.concat(F.lit(" "), token))
                    .otherwise(F.concat(token, F.lit(" ")))
                )
                between = escape(F.substring(chunk, F.lit(1), skipped))
                return F.struct(misfit.alias("misfit"), F.concat(between, placed).alias("shown"))

            return bind(F.substring(text, cursor(i) + 1, e["end"] - cursor(i)), shown)

        def joined(parts: Column) -> Column:
            rest = escape(F.substring(text, cursor(F.size(es)) + 1, F.length(text)))
            whole = F.concat(F.array_join(F.transform(parts, lambda p: p["shown"]), ""), rest)
            return F.when(~F.exists(parts, lambda p: p["misfit"]), whole)

        return bind(F.length(text), lambda n: bind(each(es, lambda e, i: part(e, i, n)), joined))

    return bind(ordered, build)


def source_text(correction: Column) -> Column:
    """The learner's text behind a correction; unreadable markup is returned as it is."""

    def known(t: Column) -> Column:
        return (
            F.when(F.lower(t) == "null", "null")
            .when(~(F.contains(t, F.lit("[")) & F.contains(t, F.lit("]"))), t)
            .otherwise(F.coalesce(parse_markup(t)["text"], t))
        )

    return F.when(correction.isNull(), "null").otherwise(bind(strip(correction), known))


def corrected_text(correction: Column) -> Column:
    """The corrected sentence: every edit gives way to its replacement."""
    pattern = F.lit(EDIT_PATTERN + r"|[^\[]++|\[")

    def known(t: Column) -> Column:
        parts = F.struct(
            F.regexp_extract_all(t, pattern, F.lit(0)).alias("raw"),
            F.regexp_extract_all(t, pattern, F.lit(2)).alias("new"),
            F.regexp_extract_all(t, pattern, F.lit(3)).alias("tag"),
        )
        joined = bind(
            parts,
            lambda s: F.array_join(
                each(
                    s["raw"],
                    lambda x, i: F.when(at(s["tag"], i) != "", unescape(at(s["new"], i)))
                    .otherwise(x),
                ),
                "",
            ),
        )
        def squeezed(x: Column) -> Column:
            return F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " ++", " ")).otherwise(x)

        # Without escapes each edit is what stands in it.
        plain = strip_ends(bind(F.regexp_replace(t, PLAIN_EDIT, "$1"), squeezed))
        return (
            F.when(says_null(t), "null")
            .when(~(F.contains(t, F.lit("[")) & F.contains(t, F.lit("]"))), t)
            .when(~F.contains(t, F.lit("\\")), plain)
            .otherwise(strip(F.regexp_replace(unescape(joined), " ++", " ")))
        )

    return F.when(correction.isNull(), "null").otherwise(bind(strip_ends(correction), known))


def triples(edits: Column) -> Column:
    """The distinct ``(start, end, tag)`` of an edit array as text; empty when there is none.

    Sets of strings are told apart by hashing, sets of structs pair by pair.
    """

    def named(e: Column) -> Column:
        places = [F.coalesce(e[x].cast("string"), F.lit("-")) for x in ("start", "end")]
        return F.concat_ws(" ", *places, e["tag"])

    return F.coalesce(F.array_distinct(F.transform(edits, named)), F.array().cast("array<string>"))


def penalty(
    edits: Column,
    n_words: Column,
    group: str,
    weights: dict[str, int] | None = None,
    members: dict[str, list[str]] | None = None,
) -> Column:
    """Summed weight of one group's edits over the square root of the word count.

    ``members`` lists the tags of each group; without it the two groups of the taxonomy count.
    """
    weights = weights or WEIGHTS
    mine = {t: w for t, w in weights.items() if (t in members[group] if members else (t in USAGE_TAGS) == (group == "usage"))}
    if not mine:
        return F.lit(0.0)
    summed = F.aggregate(
        edits,
        F.lit(0),
        lambda a, e: a + F.coalesce(F.try_element_at(literal_map(mine), e["tag"]), F.lit(0)),
    )
    return summed / F.sqrt(F.greatest(n_words, F.lit(1)))


def band_of(value: Column, thresholds: list[float] | None = None) -> Column:
    band = F.lit(MAX_BAND)
    for cut in thresholds or THRESHOLDS:
        band = band - F.when(value > F.lit(float(cut)), 1).otherwise(0)
    return band
