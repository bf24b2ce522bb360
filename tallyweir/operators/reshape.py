"""Long and wide forms, appends."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], names_to: str = "name", values_to: str = "value"
) -> DataFrame:
    return df.unpivot(list(keys), list(values), names_to, values_to)


def to_wide(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str,
    names: Sequence[Any],
    value: Column,
    fill: float | None = 0.0,
    other: str | None = "other",
) -> DataFrame:
    """One column per listed name, and one for the rows under any other name or none. Only cells without any row are filled.

    The names are given, so no extra pass looks for them. ``other=None`` leaves rows with other names out.
    """
    if other is not None:
        listed = F.col(names_from).isin(list(names))
        df = df.withColumn(names_from, F.when(listed, F.col(names_from).cast("string")).otherwise(F.lit(other)))
        names = [*map(str, names), other]
    cells = (value.alias("v"), F.count(F.lit(1)).alias("n"))
    wide = df.groupBy(*keys).pivot(names_from, list(names)).agg(*cells)
    out = list(keys)
    for name in names:
        present = F.coalesce(F.col(f"`{name}_n`"), F.lit(0)) > 0
        out.append(F.when(present, F.col(f"`{name}_v`")).otherwise(F.lit(fill)).alias(str(name)))
    return wide.select(*out)


def append(*frames: DataFrame, fill_missing: bool = False) -> DataFrame:
    """Stack tables by column name, keeping duplicates; optionally with NULL for absent columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=fill_missing)
    return out
