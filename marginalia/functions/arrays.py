"""Small array helpers built from the built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A lambda variable is opaque to the optimizer, so an expensive expression bound here is
    not copied to each place that reads it. The value starts a fold over no elements, whose last
    step is ``body``: a ``transform`` would copy whatever the body gives, and so once per nested bind.
    """
    return F.aggregate(F.array(), value, lambda held, _: held, body)


def each(values: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``transform`` with the element and its 0-based position."""
    return F.transform(values, lambda x, i: body(x, i))


def at(values: Column, index: Column) -> Column:
    """Element at a 0-based position, null when outside."""
    return F.get(values, index)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_total(values: Column, block: int = 16) -> Column:
    """Exclusive prefix sums of an int array: one more entry than the input.

    Each block of elements is folded into its own prefix sums, and the blocks are then moved
    by the totals before them; so a step copies at most one block, not the whole prefix.
    """

    def fold(v: Column) -> Column:
        return F.aggregate(
            v,
            F.array(F.lit(0)),
            lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x),
        )

    def moved(blocks: Column) -> Column:
        starts = fold(F.transform(blocks, lambda p: F.element_at(p, -1)))

        def shift(p: Column, start: Column) -> Column:
            return F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + start)

        return bind(
            starts,
            lambda st: F.concat(
                F.flatten(each(blocks, lambda p, i: bind(at(st, i), lambda s: shift(p, s)))),
                F.slice(st, F.lit(-1), F.lit(1)),
            ),
        )

    def blocked(v: Column) -> Column:
        last = F.ceil(F.size(v) / F.lit(block)).cast("int") - 1
        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda b: fold(F.slice(v, b * block + 1, F.lit(block))),
        )
        return F.when(F.size(v) <= block, fold(v)).otherwise(bind(blocks, moved))

    return bind(values, blocked)


def first_match(values: Column, keep: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(values, keep), F.lit(0))


def with_columns_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add expensive columns so that later steps do not evaluate them again.

    They come out of a one-element ``inline``. The optimizer neither pushes a filter on a
    generated column below its generator nor copies the expression into what reads it, which
    a plain projection allows.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(made))
