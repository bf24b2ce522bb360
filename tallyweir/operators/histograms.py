"""Histogram, bar and box statistics as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.missing import col, n_rows, sum_known
from tallyweir.functions.numbers import bin_centre
from tallyweir.operators.aggregates import exact_quantiles
from tallyweir.operators.joins import left_join, small_side


def fixed_width(df: DataFrame, x: str | Column, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per bin; bins are centred on multiples of the width and closed on the right."""
    known = df.withColumn("_x", col(x).cast("double")).where(F.col("_x").isNotNull())
    return known.groupBy(*keys, bin_centre("_x", width).alias("bin")).agg(n_rows().alias("n"))


def fixed_count(df: DataFrame, x: str | Column, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per bin for a given number of bins over the common range of all groups."""
    known = df.withColumn("_x", col(x).cast("double")).where(F.col("_x").isNotNull())
    step = known.agg(((F.max("_x") - F.min("_x")) / F.lit(float(bins - 1))).alias("w")).scalar()
    steps = F.ceil(F.try_divide(F.col("_x"), step) - F.lit(0.5))
    return (
        known.groupBy(*keys, F.coalesce(steps, F.lit(0)).alias("bin_no")).agg(n_rows().alias("n"))
        .withColumn("bin", F.coalesce(F.col("bin_no") * step, F.lit(0.0)))
    )


def stacked_bars(
    df: DataFrame, x: str, fill: str, value: str, keys: Sequence[str] = (), mirrored: Column | None = None
) -> DataFrame:
    """Totals by position and fill; groups where ``mirrored`` holds point downwards."""
    out = df.groupBy(*keys, x, fill).agg(sum_known(value).alias("total"))
    return out if mirrored is None else out.withColumn("total", F.when(mirrored, -F.col("total")).otherwise(F.col("total")))


def box_summary(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends (last values within 1.5 IQR) and the number of outliers."""
    box = exact_quantiles(df, value, (0.25, 0.5, 0.75), keys).select(
        *keys, "n", F.col("q0").alias("lower"), F.col("q1").alias("middle"), F.col("q2").alias("upper")
    )
    reach = (F.col("upper") - F.col("lower")) * 1.5
    box = small_side(box.withColumns({"_from": F.col("lower") - reach, "_to": F.col("upper") + reach}))
    inside = F.col(value).between(F.col("_from"), F.col("_to"))
    return (
        left_join(df.where(F.col(value).isNotNull()).select(*keys, value), box, keys)
        .groupBy(*keys, "n", "lower", "middle", "upper")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )
