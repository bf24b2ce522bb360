"""Data checks: each returns the offending rows, or raises when a table is empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.missing import n_rows
from tallyweir.operators.joins import unmatched


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The table itself; raises when it has no row (reads until the first row only)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def both_set(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with two marks that exclude each other."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def violation_count(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("violations"))


def label_mismatch(df: DataFrame, recorded: str, computed: str) -> DataFrame:
    """Rows where both labels are known and differ."""
    return df.where(F.col(recorded) != F.col(computed))


def unmapped(df: DataFrame, source: str, mapped: str) -> DataFrame:
    """Source values that a recode did not cover, with their number of rows."""
    return df.where(F.col(mapped).isNull()).groupBy(source).agg(n_rows().alias("n"))


def drop_matching(df: DataFrame, rules: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows for which no exclusion rule exists. A typed-in rule table has a known size and needs no hint."""
    return unmatched(df, rules, on, null_safe=False)
