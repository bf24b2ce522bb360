"""Writers and presentation projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of CSV parts with headers; empty cells for NULL (text blanks are quoted)."""
    df.write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", spread: int | None = None
) -> None:
    """Columnar copy, optionally split in folders (year, station) that later scans can prune.

    A folder that holds most of the rows is written by up to ``spread`` tasks (the session's number of shuffle
    partitions unless it is given), not by one: the shuffle key adds a bucket of the row's hash.
    """
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    tasks = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*df.columns), F.lit(tasks))
    df.repartition(*partition_by, bucket).write.mode(mode).partitionBy(*partition_by).parquet(path)


def store_series(df: DataFrame, path: str, station: str = "station_number", date: str = "date") -> None:
    """Write a daily series in folders by station and year, replacing only the folders that ``df`` has rows for.

    So a new month, or a corrected year of one station, is written without the rest. A year of a station is a few hundred
    rows; it is one file.
    """
    dated = df.withColumn("year", F.year(F.col(date)))
    (
        dated.repartition(station, "year").sortWithinPartitions(station, "year", date)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(station, "year").parquet(path)
    )


def present(df: DataFrame, headings: Mapping[str, str]) -> DataFrame:
    """Chosen columns in the given order under their display names."""
    return df.select(*[F.col(name).alias(title) for name, title in headings.items()])
