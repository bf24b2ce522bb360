"""Effort summaries and what-if scenarios on daily totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.dates import day_of_year
from tallyweir.functions.missing import n_rows, ratio, sum_known
from tallyweir.operators.joins import full_join


def hours_by(effort: DataFrame, keys: Sequence[str], hours: str = "hours") -> DataFrame:
    return effort.groupBy(*keys).agg(sum_known(hours).alias("hours"))


def season_summary(effort: DataFrame, keys: Sequence[str], date: str = "date", minutes: str | None = None) -> DataFrame:
    """First and last day and number of days worked (a missing date counts as one day)."""
    measures = [
        F.min(date).alias("start_date"),
        F.max(date).alias("finish_date"),
        (F.count_distinct(F.col(date)) + F.max(F.col(date).isNull().cast("long"))).alias("days_total"),
    ]
    if minutes:
        measures.append((sum_known(minutes) / 60).alias("hours_total"))
    return effort.groupBy(*keys).agg(*measures)


def season_effort(
    effort: DataFrame,
    fish: DataFrame,
    year: str = "year",
    date: str = "date",
    on: Sequence[str] = ("year", "date", "time_of_day"),
    hours_per_check: Sequence[float] = (1.5, 2.0),
) -> DataFrame:
    """Season dates, days, checks and hours from effort fully joined to catch.

    The join would pair every catch row with every check of its visit, so both sides are first
    reduced to one row per visit. Catch without any recorded check counts as one unknown check
    per year, as a missing id is a distinct value there.
    """
    checks = effort.groupBy(*on).agg(n_rows().alias("_checks"))
    visits = fish.groupBy(*on).agg(n_rows().alias("_fish"))
    both = full_join(checks, visits, on)
    out = both.groupBy(year).agg(
        F.min(date).alias("start_date"),
        F.max(date).alias("finish_date"),
        (F.count_distinct(F.col(date)) + F.max(F.col(date).isNull().cast("long"))).alias("days_total"),
        (F.coalesce(F.sum("_checks"), F.lit(0)) + F.max(F.col("_checks").isNull().cast("long"))).alias("checks_total"),
    )
    for each in hours_per_check:
        out = out.withColumn(f"hours_at_{each:g}".replace(".", "_"), F.col("checks_total") * float(each))
    return out


def days_over(daily: DataFrame, total: str, thresholds: Sequence[float], year: str = "year") -> DataFrame:
    """Days per year on which the total reached each threshold; years without such a day are absent."""
    counts = [F.count_if(F.col(total) >= t).alias(f"_{i}") for i, t in enumerate(thresholds)]
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("days")) for i, t in enumerate(thresholds)
    ]
    wide = daily.groupBy(year).agg(*counts)
    return wide.select(year, F.inline(F.array(*rows))).where(F.col("days") > 0)


def capped_tagging(
    daily: DataFrame,
    total: str,
    scenarios: Sequence[tuple[float, int | None]],
    year: str = "year",
    date: str = "date",
) -> DataFrame:
    """Share tagged if only the first ``cap`` animals of a day are tagged, optionally up to a day of year.

    All scenarios are evaluated in one pass over the daily totals. Years without a day inside the
    cut-off are absent.
    """
    measures, rows = [], []
    for i, (cap, cut) in enumerate(scenarios):
        inside = F.lit(True) if cut is None else day_of_year(date) <= cut
        kept = F.when(inside, F.col(total).cast("double"))
        measures += [
            F.sum(kept).alias(f"_t{i}"),
            F.sum(F.when(kept.isNotNull(), F.least(kept, F.lit(float(cap))))).alias(f"_c{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(float(cap)).alias("cap"),
                F.lit(cut).cast("int").alias("last_day"),
                F.col(f"_t{i}").alias("total"),
                F.col(f"_c{i}").alias("tagged"),
            )
        )
    out = daily.groupBy(year).agg(*measures).select(year, F.inline(F.array(*rows)))
    return out.where(F.col("total").isNotNull()).withColumn("percent_tagged", ratio("tagged", "total") * 100)
