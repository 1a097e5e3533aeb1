"""Line edits over numbered units: ``START END TAG REPLACEMENT``, 1-based and end-exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrays import at, bind, each, first_match
from marginalia.functions.batches import printed_edits
from marginalia.functions.markup import escape, parse_markup, render_markup
from marginalia.functions.text import LINE_BREAK, WS, strip, units
from marginalia.schemas import TAGS

SPAN = "array<struct<start:bigint,end:bigint,tag:string,replacement:string>>"


def numbered_edits(us: Column, edits: Column) -> Column:
    """Edits over characters as spans over 1-based units, in their order.

    Where units begin and where edits begin and end are sorted together, an edit's edge before a
    unit that begins there. In that one sequence the units before an edge are its place less the
    edges before it, so no edit looks through the units.
    """
    flag = 1 << 31

    def edges(e: Column, i: Column) -> Column:
        ends = ((e["start"], i * 2), (e["end"], i * 2 + 1))
        return F.array(*[F.shiftleft(p.cast("bigint"), 32) + n.cast("bigint") for p, n in ends])

    begins = F.transform(us, lambda u: F.shiftleft(u["start"].cast("bigint"), 32) + F.lit(flag).cast("bigint"))
    swept = F.sort_array(F.concat(F.flatten(each(edits, edges)), begins))
    asked = F.filter(
        each(swept, lambda x, p: F.struct(x.alias("x"), p.alias("p"))), lambda s: s["x"].bitwiseAND(F.lit(flag)) == 0
    )
    # The number of the edge above the count of units, sorted back into the order of the edits.
    by_edge = F.sort_array(
        each(asked, lambda s, q: F.shiftleft(s["x"].bitwiseAND(F.lit(flag - 1)), 32) + (s["p"] - q).cast("bigint"))
    )
    counts = F.transform(by_edge, lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))

    def spans(s: Column) -> Column:
        def span(e: Column, i: Column) -> Column:
            before, until = at(s["counts"], i * 2), at(s["counts"], i * 2 + 1)
            # Behind a unit that has not ended, a span begins with that unit.
            inside = F.coalesce(at(s["us"], before - 1)["end"] > e["start"], F.lit(False))
            here = F.coalesce(at(s["us"], before)["start"] == e["start"], F.lit(False))
            first = F.when(inside & ~here, before).otherwise(before + 1)
            insert = e["start"] == e["end"]
            return F.struct(
                F.when(insert, before + 1).otherwise(first).cast("bigint").alias("start"),
                F.when(insert, before + 1).when(until > 0, until + 1).otherwise(first).cast("bigint").alias("end"),
                e["tag"].alias("tag"),
                e["replacement"].alias("replacement"),
            )

        return each(s["edits"], span)

    return bind(F.struct(us.alias("us"), edits.alias("edits"), counts.alias("counts")), spans)


def _corrected(text: Column, correction: Column, known: Column | None, found: Callable[[Column], Column], signal: Callable[[str], Column]) -> Column:
    """``found`` of the spans of a marked-up correction, or ``signal`` of OK or NULL.

    ``known`` has the units of ``text``, if they are at hand.
    """

    def of(p: Column) -> Column:
        us = units(p["text"]) if known is None else F.when(p["text"] == text, known).otherwise(units(p["text"]))
        return bind(us, lambda u: found(numbered_edits(u, p["edits"])))

    def read(c: Column) -> Column:
        return bind(
            parse_markup(c),
            lambda p: F.when(p["error"].isNotNull(), signal("NULL")).when(F.size(p["edits"]) == 0, signal("OK")).otherwise(of(p)),
        )

    return bind(
        strip(F.coalesce(correction, F.lit("null"))),
        lambda c: F.when(c == "null", signal("NULL")).when((c == "") | (strip(text) == c), signal("OK")).otherwise(read(c)),
    )


def _printed(spans: Column) -> Column:
    def line(e: Column) -> Column:
        tail = F.when(e["replacement"] != "", F.concat(F.lit(" "), e["replacement"])).otherwise("")
        whole = F.concat(F.concat_ws(" ", e["start"], e["end"], e["tag"]), tail)
        return F.when(e["start"] == e["end"], strip(whole)).otherwise(whole)

    return F.array_join(F.transform(spans, line), "\n")


def lines_by_expression(text: Column, correction: Column) -> Column:
    """``lines_of_edits`` without a batch step, for any row."""
    return _corrected(text, correction, None, _printed, F.lit)


def lines_of_edits(text: Column, correction: Column, closer: Column | None = None) -> Column:
    """Line edits for a marked-up correction; ``OK`` for none, ``NULL`` for unreadable.

    Plain markup is read a batch of rows at a time; ``closer`` is the expression for the others, if it is at hand.
    """
    return F.coalesce(printed_edits(text, correction), lines_by_expression(text, correction) if closer is None else closer)


def read_correction(text: Column, correction: Column, known: Column) -> Column:
    """``struct(signal, spans)`` of a marked-up correction, as ``read_lines`` reads its line edits.

    ``known`` has the units of ``text``. Nothing is printed, but for a replacement that holds a line break: its line is torn.
    """
    none = F.array().cast(SPAN)

    def signal(s: str) -> Column:
        return F.struct(F.lit(s).alias("signal"), none.alias("spans"))

    def found(spans: Column) -> Column:
        def trimmed(s: Column) -> Column:
            return F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["tag"].alias("tag"), strip(s["replacement"]).alias("replacement")
            )

        return bind(
            spans,
            lambda all_: F.when(
                F.exists(all_, lambda s: s["replacement"].rlike(LINE_BREAK)), read_lines(_printed(all_))
            ).otherwise(F.struct(F.lit(None).cast("string").alias("signal"), F.transform(all_, trimmed).cast(SPAN).alias("spans"))),
        )

    return _corrected(text, correction, known, found, signal)


def read_lines(output: Column) -> Column:
    """``struct(signal, spans)``: the signal is OK or NULL, or null when there are spans."""

    def number(x: Column) -> Column:
        return F.when(F.rlike(x, F.lit(r"^[+-]?\d+$")), x.try_cast("bigint"))

    def spans(t: Column) -> Column:
        found = F.transform(
            F.split(t, LINE_BREAK),
            lambda raw: bind(
                F.split(strip(raw), rf"(?U){WS}++", 4),
                lambda x: F.struct(
                    number(at(x, F.lit(0))).alias("start"),
                    number(at(x, F.lit(1))).alias("end"),
                    at(x, F.lit(2)).alias("tag"),
                    F.coalesce(at(x, F.lit(3)), F.lit("")).alias("replacement"),
                ),
            ),
        )
        whole = F.filter(
            found, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["tag"].isNotNull()
        )
        return whole.cast(SPAN)

    def decide(t: Column) -> Column:
        return bind(
            spans(t),
            lambda s: F.struct(
                F.when((t == "OK") | (t == ""), "OK")
                .when((t == "NULL") | (F.size(s) == 0), "NULL")
                .alias("signal"),
                s.alias("spans"),
            ),
        )

    return bind(strip(output), decide)


def fault_of_spans(read: Column, n_units: Column) -> Column:
    """First fault of parsed line edits in their given order; ``valid`` when there is none."""

    def first_fault(s: Column) -> Column:
        spans, top = s["spans"], s["top"]

        def fault(e: Column, i: Column) -> Column:
            before = F.when(i > 0, at(spans, i - 1)["end"]).otherwise(F.lit(-1))
            return (
                F.when((e["start"] < 1) | (e["start"] > top), "start_out_of_bounds")
                .when((e["end"] < e["start"]) | (e["end"] > top), "invalid_span")
                .when(~e["tag"].isin(TAGS), "invalid_tag")
                .when(e["start"] < before, "overlapping_span")
            )

        return first_match(each(spans, fault), lambda f: f.isNotNull())

    found = bind(F.struct(read["spans"].alias("spans"), (n_units + 1).alias("top")), first_fault)
    return F.when(read["signal"].isNotNull(), "valid").otherwise(F.coalesce(found, F.lit("valid")))


def markup_of_lines(text: Column, output: Column) -> Column:
    """Marked-up correction for line edits over a text; the bare text when they clash."""

    def build(s: Column) -> Column:
        us, n = s["units"], F.size(s["units"])

        def edit(e: Column) -> Column:
            # An insert past the last unit goes to the end of the text.
            place = F.when(e["start"] >= 1, e["start"]).otherwise(e["start"] - 1).cast("int")
            point = F.when(e["start"] > n, F.length(text)).otherwise(
                F.try_element_at(us, place)["start"]
            )
            first = F.greatest(F.lit(1), F.least(e["start"], n))
            last = F.greatest(first, F.least(e["end"], n + 1) - 1)
            begin = F.try_element_at(us, first.cast("int"))["start"]
            finish = F.try_element_at(us, last.cast("int"))["end"]
            insert = e["start"] == e["end"]
            return F.struct(
                F.when(insert, "").otherwise(F.substring(text, begin + 1, finish - begin)).alias(
                    "original"
                ),
                e["replacement"].alias("replacement"),
                e["tag"].alias("tag"),
                F.when(insert, point).otherwise(begin).cast("int").alias("start"),
                F.when(insert, point).otherwise(finish).cast("int").alias("end"),
            )

        ordered = F.sort_array(
            each(
                s["spans"],
                lambda e, i: F.struct(
                    e["start"].alias("start"), e["end"].alias("end"), i.alias("i"),
                    e["tag"].alias("tag"), e["replacement"].alias("replacement"),
                ),
            )
        )
        made = F.transform(ordered, edit)
        return bind(made, lambda m: F.coalesce(render_markup(text, m), text))

    return bind(
        read_lines(output),
        lambda r: F.when(r["signal"] == "NULL", "null")
        .when(r["signal"] == "OK", escape(text))
        .otherwise(
            bind(F.struct(units(text).alias("units"), r["spans"].alias("spans")), build)
        ),
    )
