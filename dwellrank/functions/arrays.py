"""Array building blocks: let-binding, row explosion, running totals.

All are plain Column expressions, so they run inside the JVM on one row at a
time and need no shuffle: the arrays are the words or sentences of one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Without the binding Spark would inline the expression into every lambda
    call, so a regular expression over the text would run once per word.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_rows(df: DataFrame, keep: list, items: Column, pos: str, value: str) -> DataFrame:
    """One row per array item with its position.

    A plain explode makes Spark add the filter ``size(items) > 0`` below it,
    which computes a costly array twice and moves it before earlier
    reductions; the outer form with a filter on the position does not.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, value)).where(F.col(pos).isNotNull())


def index_range(n: Column) -> Column:
    """[0, 1, ..., n-1]; empty for n = 0 (``sequence(0, -1)`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    """Sum of an array of doubles, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def running_totals(lengths: Column) -> Column:
    """Inclusive prefix sums of an int array.

    Appending to one growing array copies it at every step, so the work is cut
    into about sqrt(n) blocks: totals per block first, then the sums inside
    each block on top of the block's offset.
    """

    def append_sum(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def blocks(a: Column, width: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(a), width)

        def with_offsets(begin: Column) -> Column:
            sums = F.transform(
                begin, lambda s: F.aggregate(F.slice(a, s, width), F.lit(0), lambda acc, x: acc + x)
            )
            offsets = F.aggregate(sums, F.array(F.lit(0)), append_sum)
            return let(
                offsets,
                lambda off: F.flatten(
                    F.transform(
                        begin,
                        lambda s, b: let(
                            F.slice(a, s, width),
                            lambda part: F.slice(
                                F.aggregate(part, F.array(F.get(off, b)), append_sum), F.lit(2), F.size(part)
                            ),
                        ),
                    )
                ),
            )

        return let(starts, with_offsets)

    return let(
        lengths,
        lambda a: F.when(
            F.size(a) > 0,
            let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(a))).cast("int")), lambda width: blocks(a, width)),
        ).otherwise(F.array().cast("array<int>")),
    )

