"""Column expressions shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two word patterns of the contracts.
BLANKS = r"[\x20\x09-\x0D]+"
ASCII_NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, gap: str = BLANKS) -> Column:
    """The runs of characters between gaps, in order; none for a null text."""
    return F.array_remove(F.split(whole(text), gap, -1), F.lit(""))


def positions(count: Column) -> Column:
    """0, 1, ... count - 1; empty if the count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def covered(starts: Column, width: int) -> Column:
    """How many positions the intervals [start, start + width) cover; starts ascend."""

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda s, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - s, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda sum_, n: sum_ + n)

    return let(starts, total)


def window_hashes(items: Column, width: int) -> Column:
    """A 64-bit hash of every window of ``width`` consecutive items."""
    return let(
        F.transform(items, lambda x: F.xxhash64(x)),
        lambda h: F.transform(
            positions(F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        ),
    )


def repeated_windows(items: Column, width: int) -> Column:
    """Start positions, ascending, of the windows of ``width`` items that occur twice or more in the array.

    Equal windows have equal 64-bit hashes. Most texts repeat none, which a distinct count shows; the
    others sort their (hash, position) pairs inside the row, so a long text costs n log n.
    """

    def found(pairs: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            return F.coalesce(x["h"] == F.get(pairs, j)["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, lambda x, j: twin(x, j - 1) | twin(x, j + 1)), lambda x: x["i"]))

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<int>")).otherwise(
            let(F.sort_array(pairs), found)
        )

    return let(window_hashes(items, width), of_hashes)
