"""Text columns: whitespace, words, word units, shape checks, n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrays import at, bind, each, running_total

# Whitespace and word characters are spelled out because the defaults of the regex engine
# are ASCII-only.
WS = r"[\s\x1c-\x1f]"
# Every whitespace character but the plain blank; each becomes one blank of equal length.
OTHER_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"
UNIT = (
    r"[\p{L}\p{Nl}\p{No}]+?(?=n't(?!" + WORD + r"))"
    r"|n't"
    r"|" + WORD + r"++"
    r"|[^\p{L}\p{N}_\s\x1c-\x1f]"
)
PLAIN_UNIT = WORD + r"++|[^\p{L}\p{N}_\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(value: Column) -> Column:
    """Trim every kind of whitespace from both ends.

    Only where there is whitespace does the second pattern look back whether it begins there.
    """
    return F.regexp_replace(value, rf"(?U)^{WS}++|{WS}(?<!{WS}{WS}){WS}*+\z", "")


def strip_ends(value: Column) -> Column:
    """``strip``, which goes through the text only where its first or last character is whitespace."""

    def ends(v: Column) -> Column:
        outer = F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1))
        return F.when(F.rlike(outer, F.lit(rf"(?U){WS}")), strip(v)).otherwise(v)

    return bind(value, ends)


def says_null(value: Column) -> Column:
    """Is it the word null in any case? Nothing of another length is."""
    return (F.octet_length(value) == 4) & (F.lower(value) == "null")


def squeeze(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?U){WS}++", " ")


def fold_case(value: Column) -> Column:
    """Case folding: upper then lower maps the sharp s to ss, as folding does.

    The empty suffix keeps the two from being simplified to a plain lower.
    """
    return F.replace(F.lower(F.concat(F.upper(value), F.lit(""))), F.lit("ς"), F.lit("σ"))


def words(value: Column) -> Column:
    return F.filter(F.split(value, rf"(?U){WS}++"), lambda w: w != "")


def n_words(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"(?U)[^\s\x1c-\x1f]++"))


def shape_fault(value: Column) -> Column:
    """Why a sentence is unusable on shape alone; null when it is fine."""
    return bind(
        strip(value),
        lambda t: F.when(t == "", "empty")
        .when(F.length(t) < 3, "too_short")
        .when(F.length(t) > 600, "too_long")
        .when(F.contains(t, F.lit("\n")), "multiline"),
    )


def mentions(text: Column, target: Column) -> Column:
    """Whether any word of the target (first four letters of long ones) occurs in the text."""
    stems = F.transform(
        F.filter(words(F.lower(target)), lambda w: ~w.isin("sb", "sth")),
        lambda w: F.when(F.length(w) > 5, F.substring(w, 1, 4)).otherwise(w),
    )
    return bind(
        F.struct(stems.alias("stems"), F.lower(text).alias("low")),
        lambda s: (F.size(s["stems"]) == 0)
        | F.exists(s["stems"], lambda w: F.contains(s["low"], w)),
    )


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9']+"), F.lit(0))


def ngrams(token_array: Column, n: int) -> Column:
    """All n-grams as blank-joined strings; empty when there are fewer than n tokens."""
    return F.when(
        F.size(token_array) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(token_array) - F.lit(n - 1)),
            lambda i: F.array_join(F.slice(token_array, i, F.lit(n)), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _led_units(value: Column) -> Column:
    """Word and punctuation units, each with the blanks before it."""

    def cut(pattern: str) -> Callable[[Column], Column]:
        return lambda t: F.regexp_extract_all(t, F.lit(rf"(?U) *+(?:{pattern})"), F.lit(0))

    # Words have to be looked at letter by letter only where one may end in n't.
    return bind(
        F.regexp_replace(value, OTHER_WS, " "),
        lambda t: F.when(F.contains(t, F.lit("n't")), cut(UNIT)(t)).otherwise(cut(PLAIN_UNIT)(t)),
    )


def unit_tokens(value: Column) -> Column:
    """The tokens of ``units``, for which no offset has to be known."""
    return F.transform(_led_units(value), lambda x: F.ltrim(x))


def units(value: Column) -> Column:
    """Word and punctuation units with character offsets, in order.

    Every character is either whitespace or part of a unit, so the offsets are the running
    sums of the lengths of units with the blanks before them.
    """

    def with_offsets(led: Column) -> Column:
        def unit(token: Column, end: Column) -> Column:
            return F.struct(
                token.alias("token"), (end - F.length(token)).alias("start"), end.alias("end")
            )

        return bind(
            running_total(F.transform(led, F.length)),
            lambda ends: each(led, lambda x, i: unit(F.ltrim(x), at(ends, i + 1))),
        )

    return bind(_led_units(value), with_offsets)


def multi_sentence(value: Column) -> Column:
    return F.rlike(value, F.lit(rf"(?U)[.!?]{WS}+[A-Z0-9]"))
