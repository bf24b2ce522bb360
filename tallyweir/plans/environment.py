"""Daily catch, water level, temperature and discharge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions import dates
from tallyweir.functions.missing import sum_known
from tallyweir.operators.joins import align_series
from tallyweir.operators.regression import factor_line_fit
from tallyweir.sources.readers import station_series


def daily_catch(fish: DataFrame, excluded: str = "co-f") -> DataFrame:
    """Animals per day without one species code; rows without a code are left out as well."""
    return fish.where(F.col("species") != excluded).groupBy("date").agg(sum_known("count").alias("total"))


def daily_environment(effort: DataFrame) -> DataFrame:
    return effort.groupBy("date", "site").agg(
        F.avg("water_level_m").alias("mean_level"), F.avg("water_temp_c").alias("mean_temp")
    )


def unit_values_to_daily(units: DataFrame, stamp: str = "ts") -> DataFrame:
    """Instrument readings to one mean per station, day and parameter."""
    return (
        units.groupBy("station_number", F.col(stamp).cast("date").alias("date"), "parameter")
        .agg(F.avg("value").alias("value"))
        .withColumns({"year": F.year("date"), "year_day": dates.day_of_year("date")})
    )


def catch_and_discharge(
    fish: DataFrame, hydro: DataFrame, station: str, first: str, last: str, factor: float = 1000.0,
    excluded: str = "co-f",
) -> DataFrame:
    """Daily catch beside discharge scaled to the catch axis, for one date window.

    The window is applied to both inputs, so it prunes both scans.
    """
    window = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    catch = daily_catch(fish.where(window), excluded)
    flow = (
        station_series(hydro, station, first, last).where(F.col("parameter") == "Flow")
        .select("date", F.col("value").alias("discharge"))
    )
    return align_series(catch, flow, ["date"], scale={"discharge": factor})


def level_comparison(
    effort: DataFrame, hydro: DataFrame, station: str, site: str, first: str, last: str, offset: float = 0.4
) -> DataFrame:
    """Mean level read at the site (shifted to the gauge datum) beside the station's level."""
    window = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    here = (
        effort.where(window & (F.col("site") == site)).groupBy("date")
        .agg(F.avg("water_level_m").alias("site_level"))
    )
    there = (
        station_series(hydro, station, first, last).where(F.col("parameter") == "Level")
        .select("date", F.col("value").alias("station_level"))
    )
    return align_series(here, there, ["date"], shift={"site_level": offset})


def temperature_readings(effort: DataFrame, first: str, last: str) -> DataFrame:
    """Single readings with their full time stamp, for one date window."""
    window = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    stamp = dates.with_time_of_day("date", "arrival_time_24h")
    return effort.where(window).select("date", "site", "type", stamp.alias("date_time"), "water_temp_c")


def temperature_trend(effort: DataFrame) -> DataFrame:
    """Degrees per day with a site effect, on daily means."""
    return factor_line_fit(daily_environment(effort), F.unix_date("date"), "mean_temp", "site")
