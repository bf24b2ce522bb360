"""Rounding, bins, classes and text forms of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweir.functions.missing import col, if_else


def round_even(x: str | Column, digits: int = 0) -> Column:
    """Round, a half going to the even neighbour."""
    return F.bround(col(x), digits)


def bin_floor(x: str | Column, width: float) -> Column:
    """Lower edge of the equal-width bin, closed on the left."""
    return F.floor(col(x) / F.lit(float(width))).cast("double") * F.lit(float(width))


def bin_centre(x: str | Column, width: float | Column) -> Column:
    """Centre of the bin of that width, bins centred on multiples of it and closed on the right."""
    w = width if isinstance(width, Column) else F.lit(float(width))
    return F.ceil(col(x) / w - F.lit(0.5)).cast("double") * w


# Length classes in mm. Lengths in a gap (85-86, 115-116) have no class.
LENGTH_CLASSES = (
    (None, 70.0, "little"),
    (70.0, 85.0, "small"),
    (86.0, 115.0, "big"),
    (116.0, None, "bigger"),
)


def length_class(length: str | Column, classes: Sequence = LENGTH_CLASSES) -> Column:
    """Class by fixed breaks. The open lower class excludes its bound; all others include theirs."""
    x = col(length)
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(classes)):
        if low is None:
            inside = x < high
        elif high is None:
            inside = x >= low
        else:
            inside = (x >= low) & (x <= high)
        out = if_else(inside, F.lit(name), out)
    return out


def condition_factor(weight_g: str | Column, length_mm: str | Column) -> Column:
    """Fulton's K: weight over cubed length, scaled by 10^5."""
    length = col(length_mm)
    return F.try_divide(col(weight_g), length * length * length) * F.lit(100000.0)


def percent_text(x: str | Column) -> Column:
    """``12.5%`` without trailing zeros; a missing percentage reads ``0%``."""
    known = F.coalesce(col(x), F.lit(0.0))
    digits = F.regexp_replace(known.cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
    return F.concat(digits, F.lit("%"))


def level_rank(x: str | Column, levels: Sequence[str]) -> Column:
    """Position of the value in the given order (1-based); NULL when it is not listed."""
    spots = F.array(*[F.lit(level) for level in levels])
    return F.nullif(F.array_position(spots, col(x)), F.lit(0).cast("long"))
