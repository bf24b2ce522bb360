"""Missing-value rules.

The analyses use three-valued logic that differs from SQL in places: membership is never
unknown, an unknown condition gives an unknown result (not the else branch), a sum over
nothing is zero, and a mean over nothing falls back to a constant.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: str | Column) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def in_set(x: str | Column, values: Iterable[Any]) -> Column:
    """Membership as a plain TRUE/FALSE. ``None`` in ``values`` matches NULL."""
    values = list(values)
    listed = [v for v in values if v is not None]
    hit = F.coalesce(col(x).isin(listed), F.lit(False))
    return hit | col(x).isNull() if len(listed) < len(values) else hit


def keep_in(df: DataFrame, column: str, values: Iterable[Any]) -> DataFrame:
    """Rows whose value is in the set, written so that the predicate reaches the scan."""
    values = list(values)
    listed = [v for v in values if v is not None]
    hit = F.col(column).isin(listed)
    return df.where(hit | F.col(column).isNull() if len(listed) < len(values) else hit)


def if_else(condition: Column, yes: Any, no: Any) -> Column:
    """Two-way choice that stays NULL when the condition is NULL."""
    return F.when(condition, _lit(yes)).when(~condition, _lit(no))


def _lit(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def recode(x: str | Column, mapping: Mapping[str, str], keep_unmatched: bool = True) -> Column:
    """Replace listed values; others are kept, or become NULL with ``keep_unmatched=False``."""
    x = col(x)
    out = None
    for old, new in mapping.items():
        out = F.when(x == old, new) if out is None else out.when(x == old, new)
    return out.otherwise(x) if keep_unmatched else out


def blank_to_null(x: str | Column) -> Column:
    return F.nullif(col(x), F.lit(""))


def default_to(x: str | Column, value: Any) -> Column:
    return F.coalesce(col(x), F.lit(value))


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``, NULL when ``b`` is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio_or(a: str | Column, b: str | Column, default: float) -> Column:
    return F.coalesce(ratio(a, b), F.lit(float(default)))


# ---- aggregates -------------------------------------------------------------------------


def sum_known(x: str | Column) -> Column:
    """Sum that ignores NULL; zero when nothing is known."""
    return F.coalesce(F.sum(col(x)), F.lit(0.0))


def sum_strict(x: str | Column) -> Column:
    """Sum that is NULL as soon as one value is missing."""
    x = col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0.0)))


def sum_where(condition: Column, x: str | Column) -> Column:
    """Sum of ``x`` over rows where the condition holds; zero when there are none."""
    return F.coalesce(F.sum(F.when(condition, col(x))), F.lit(0.0))


def strict_sum_where(condition: Column, x: str | Column) -> Column:
    """Like :func:`sum_where`, but NULL when a value that should be added is missing."""
    x = col(x)
    return F.when(F.count_if(condition & x.isNull()) == 0, sum_where(condition, x))


def mean_or(x: str | Column, default: float) -> Column:
    return F.coalesce(F.avg(col(x)), F.lit(float(default)))


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_distinct_with_missing(x: str | Column) -> Column:
    """Number of distinct values, NULL counting as one value."""
    x = col(x)
    return F.count_distinct(x) + F.max(x.isNull().cast("long"))
