"""Table readers. Schemas are given, so no read starts with an inference pass."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tallyweir.functions.missing import nan_to_null

MAX_LITERAL_ROWS = 10_000


def snake_case(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def snake_columns(df: DataFrame) -> DataFrame:
    """Free-text headers (blanks, brackets) as plain lower-case names."""
    return df.toDF(*[snake_case(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Delimited text with a header line; empty cells and ``NA`` are missing.

    Without a schema all columns stay text (cast them with :func:`typed`).
    """
    reader = spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "NA")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast the columns named in ``schema``; a cell that does not fit, or is not a number, becomes NULL."""
    cells = []
    for f in schema.fields:
        cell = F.col(f.name).try_cast(f.dataType)
        cells.append((nan_to_null(cell) if isinstance(f.dataType, (DoubleType, FloatType)) else cell).alias(f.name))
    return df.select(*cells)


def read_csv_with_preamble(
    spark: SparkSession, path: str, schema: StructType, data_line: str
) -> DataFrame:
    """Delimited text under free lines: only lines matching ``data_line`` are data.

    The pattern, not a line count, tells data from preamble, so files may be split and read in
    parallel. Columns are named by position from ``schema``.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(data_line))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    parsed = lines.select(F.from_csv("value", columns).alias("r"))
    return parsed.select("r.*")


def read_unit_values(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Instrument export: preamble and header lines, then lines that start with an ISO date."""
    return read_csv_with_preamble(spark, path, schema, r"^\d{4}-\d{2}-\d{2}")


def station_series(
    series: DataFrame,
    station: str,
    start: str | None = None,
    end: str | None = None,
    station_col: str = "station_number",
    date_col: str | Column = "date",
) -> DataFrame:
    """One station from a start date on: partition and row-group pruning do the rest."""
    day = F.col(date_col) if isinstance(date_col, str) else date_col
    out = series.where(F.col(station_col) == station)
    if start is not None:
        out = out.where(day >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(day <= F.lit(end).cast("date"))
    return out


def stored_series(
    spark: SparkSession, path: str, stations: DataFrame | str, start: str | None = None, end: str | None = None,
    station_col: str = "station_number", date_col: str = "date",
) -> DataFrame:
    """Stations of a stored series (:func:`tallyweir.sources.writers.store_series`) between two dates.

    The folders of other stations and years are not listed in the scan. With a table of stations the choice is made at run time.
    """
    series = spark.read.parquet(path)
    years = [(F.col("year") >= F.year(F.lit(start).cast("date"))) if start else None, (F.col("year") <= F.year(F.lit(end).cast("date"))) if end else None]
    for bound in (b for b in years if b is not None):
        series = series.where(bound)
    if isinstance(stations, str):
        return station_series(series, stations, start, end, station_col, date_col)
    chosen = stations.select(F.col(station_col).alias("_station")).distinct()
    out = series.join(chosen, F.col(station_col) == F.col("_station")).drop("_station")
    if start is not None:
        out = out.where(F.col(date_col) >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col(date_col) <= F.lit(end).cast("date"))


def literal_table(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """Small lookup table typed into the analysis; its size is checked, so it may be broadcast.

    It becomes a local relation, whose size the optimizer knows without running a job.
    """
    if len(rows) > MAX_LITERAL_ROWS:
        raise ValueError("a literal table is for small lookups; write the data to a file instead")
    names = [part.split()[0] for part in schema.split(",")]
    columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
    return spark.createDataFrame(pa.table(dict(zip(names, columns))), schema)


def literal_matrix(
    spark: SparkSession, cells: Sequence[Sequence[float]], row_name: str = "row", col_name: str = "col"
) -> DataFrame:
    """Typed-in matrix in long form: 1-based row, column and value."""
    rows = [(i, j, float(v)) for i, line in enumerate(cells, 1) for j, v in enumerate(line, 1)]
    return literal_table(spark, rows, f"{row_name} INT, {col_name} INT, value DOUBLE")


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every date from ``first`` to ``last``, both included."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date"))
