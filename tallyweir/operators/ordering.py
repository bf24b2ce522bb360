"""Row ids, report orders and top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.numbers import level_rank
from tallyweir.session import stored


def with_row_id(
    df: DataFrame, order_by: Sequence[str], name: str = "row_id", partitions: int | None = None
) -> DataFrame:
    """Number all rows 1..n in the given order without sorting them in one task.

    Rows are range-partitioned and sorted, written once (as Parquet in the shared folder) so that the numbering cannot change on a
    retry, and numbered inside each partition; each partition then adds the sizes of those before
    it. Give enough columns to make the order unique: that also lets a hot value be split. ``partitions`` defaults to the
    session's number of shuffle partitions.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_last() for c in order_by]
    # monotonically_increasing_id is partition * 2^33 + position in the partition
    position = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    placed = stored(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_pos": position}),
        "row-ids",
    )
    # one row per partition, so both the window and the broadcast are bounded by their number
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_start")
    )


def sort_missing_last(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    if descending:
        return df.orderBy(*[F.col(c).desc_nulls_last() for c in columns])
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def by_levels(x: str, levels: Sequence[str]) -> list[Column]:
    """Sort keys: listed values in the given order, all others after them, alphabetically."""
    return [level_rank(x, levels).asc_nulls_last(), F.col(x).asc_nulls_last()]


def rank_rows(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Position in a report order. For finished report tables, whose rows are few."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def best_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], largest: bool = False) -> DataFrame:
    """The first row of each group in the given order, as one aggregate (no sort, no window)."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    whole = pick(F.struct(*rest), F.struct(*order_by)).alias("_best")
    return df.groupBy(*keys).agg(whole).select(*keys, "_best.*")


def first_per_group_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Up to ``k`` rows of each group. Every task keeps at most ``k`` rows per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")


def head(df: DataFrame, order: Sequence[Column], n: int = 6) -> DataFrame:
    return df.orderBy(*order).limit(n)
