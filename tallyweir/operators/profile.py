"""Profiles of wide tables by mergeable sketches, and exact distinct counts without multiplying the rows.

A sketch row per column and part (a day, a file, a month) can be stored and merged later without the rows: known and
missing values, a distinct-count sketch and a frequent-value sketch. Several exact distinct counts in one aggregate
would copy every row once per column; here each pass counts the values whose hash falls into one of several slices, for
all columns at once, with repeats removed in the map tasks first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.missing import n_rows

#: Two to this power registers in a distinct-count sketch; its relative standard error is 1.04 / sqrt(registers), at most.
REGISTERS_LOG2 = 14
DISTINCT_ERROR = 1.04 / (1 << (REGISTERS_LOG2 // 2))
#: Values that a frequent-value sketch keeps. Its counts are exact for a column with at most 3 / 4 as many values.
TRACKED = 4_096


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), tracked: int = TRACKED) -> DataFrame:
    """One row per group and column: keys, column_name, data_type, n_known, n_missing, distinct_sketch, frequent_sketch."""
    types = dict(df.dtypes)
    names = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *[_text(c).alias(f"_{i}") for i, c in enumerate(names)])
    measures = []
    for i, name in enumerate(names):
        measures.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(types[name]).alias("data_type"), F.count(f"_{i}").alias("n_known"), (n_rows() - F.count(f"_{i}")).alias("n_missing"),
            F.hll_sketch_agg(f"_{i}", F.lit(REGISTERS_LOG2)).alias("distinct_sketch"), F.expr(f"approx_top_k_accumulate(_{i}, {tracked})").alias("frequent_sketch"),
        ))
    return rows.groupBy(*keys).agg(F.array(*measures).alias("_m")).select(*keys, F.inline("_m"))


def merged_profile(sketches: DataFrame, keys: Sequence[str] = (), top: int = 3, tracked: int = TRACKED) -> DataFrame:
    """Keys, column_name, data_type, n_known, n_missing, n_distinct_approx and the most frequent values with their counts.

    ``keys`` are those that stay; the sketches of all others are merged. A missing value is no frequent one.
    """
    by = [*keys, "column_name", "data_type"]
    merged = sketches.groupBy(*by).agg(
        F.sum("n_known").alias("n_known"), F.sum("n_missing").alias("n_missing"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct_approx"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent_sketch, {tracked}), {top + 1})").alias("_top"),
    )
    known = F.slice(F.filter("_top", lambda t: t["item"].isNotNull()), 1, top)
    return merged.withColumn("most_frequent", known).drop("_top")


def exact_distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, slices: int = 1) -> DataFrame:
    """(column_name, n_distinct) of the known values of each column, by ``slices`` passes over hash slices of the values."""
    names = list(columns or df.columns)
    total = None
    for part in range(slices):
        def cell(name: str) -> Column:
            value = _text(name)
            here = value.isNotNull() & (F.pmod(F.xxhash64(value), F.lit(slices)) == part)
            return F.when(here, F.struct(F.lit(name).alias("column_name"), value.alias("value")))

        seen = df.select(F.inline(F.array_compact(F.array(*[cell(c) for c in names])))).distinct()
        counts = seen.groupBy("column_name").agg(n_rows().alias("n_distinct"))
        total = counts if total is None else total.unionAll(counts)
    listed = df.sparkSession.createDataFrame([(c,) for c in names], "column_name STRING")
    summed = total.groupBy("column_name").agg(F.sum("n_distinct").alias("n_distinct"))
    return listed.join(summed, "column_name", "left").select("column_name", F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"))
