"""Adult counting fence: effort, catch, daily series, tagging scenarios, scale subsample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions import dates
from tallyweir.functions.missing import in_set, keep_in, n_rows, recode, strict_sum_where, sum_known, sum_where
from tallyweir.functions.numbers import bin_floor
from tallyweir.operators import histograms, scenarios
from tallyweir.operators.checks import drop_matching
from tallyweir.operators.joins import full_join, left_join
from tallyweir.sources.readers import literal_table

VISIT = ("year", "date", "time_of_day")

# Mark and sex by field code; tag colours of animals counted twice, by year;
# scale books that cannot be read; last day of year of the early tagging season (15 October).
GENDER = {"af": "F", "wf": "F", "am": "M", "wm": "M", "wj": "M", "aj": "M"}
MARK = {"af": "a", "wf": "w", "am": "a", "wm": "w", "wj": "w", "aj": "a"}
SEEN_TWICE = (("orange", 2022), ("orange", 2024), ("pink", 2020))
UNREADABLE_BOOKS = (1002525, 1022865, 1002523, 1022855, 1022857)
EARLY_SEASON_END = 288
TAGGING_CAPS = ((20, None), (20, EARLY_SEASON_END), (10, EARLY_SEASON_END))


def prepared(adults: DataFrame) -> DataFrame:
    """Adds sex, mark and the overlay date. Codes outside the table stay as they are."""
    return adults.withColumns(
        {
            "gender": recode("mark_gender", GENDER),
            "mark": recode("mark_gender", MARK),
            "year_day": dates.day_of_year("date"),
            "overlay_date": dates.overlay_date("date"),
        }
    )


def effort_hours(effort: DataFrame) -> DataFrame:
    timed = effort.withColumn("hours", dates.hours_between("arrival_time", "departure_time"))
    return scenarios.hours_by(timed, ["year"])


def totals(adults: DataFrame, species: str = "co", by: Sequence[str] = ("year",)) -> DataFrame:
    """Animals (by their count column) and rows; the two differ when a row stands for several."""
    return (
        adults.where(F.col("species") == species).groupBy(*by)
        .agg(sum_known("total").alias("sum_total"), n_rows().alias("n_rows"))
    )


def without_repeats(adults: DataFrame, rules: Sequence[tuple[str, int]] = SEEN_TWICE) -> DataFrame:
    table = literal_table(adults.sparkSession, rules, "recap_tag_colour STRING, year INT")
    return drop_matching(adults, table, ["recap_tag_colour", "year"])


def daily_series(
    adults: DataFrame, effort: DataFrame, years: Sequence[int] | None = None, species: str = "co",
    rules: Sequence[tuple[str, int]] = SEEN_TWICE,
) -> DataFrame:
    """Daily total, wild, marked and broodstock numbers, with zeros on days without catch.

    Catch meets effort per visit. An animal appears once for every check of its visit, so the
    visit totals are multiplied by the number of checks instead of pairing the rows.
    """
    fish = without_repeats(prepared(adults), rules)
    checks = effort
    if years is not None:
        fish, checks = keep_in(fish, "year", years), keep_in(checks, "year", years)
    wild, marked, brood = in_set("mark", ["w"]), in_set("mark", ["a"]), in_set("broodstock", [True])
    per_visit = fish.groupBy(*VISIT).agg(
        sum_where(in_set("species", [species]), "total").alias("_total"),
        strict_sum_where(wild, "total").alias("_w"),
        strict_sum_where(brood, "total").alias("_b"),
        strict_sum_where(marked, "total").alias("_a"),
        F.lit(True).alias("_caught"),
    )
    visits = full_join(checks.groupBy(*VISIT).agg(n_rows().alias("_checks")), per_visit, VISIT)
    times = F.coalesce(F.col("_checks"), F.lit(1))

    def strict(name: str):
        gap = F.count_if(F.col("_caught").isNotNull() & F.col(name).isNull())
        return F.when(gap == 0, F.coalesce(F.sum(F.col(name) * times), F.lit(0.0)))

    return (
        visits.groupBy("year", "date")
        .agg(
            sum_known(F.col("_total") * times).alias("total"),
            strict("_w").alias("wild"), strict("_b").alias("broodstock"), strict("_a").alias("marked"),
        )
        .withColumns({"year_day": dates.day_of_year("date"), "overlay_date": dates.overlay_date("date")})
    )


def season_effort(adults: DataFrame, effort: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    if years is not None:
        adults, effort = keep_in(adults, "year", years), keep_in(effort, "year", years)
    return scenarios.season_effort(effort, adults)


def daily_rows(adults: DataFrame, effort: DataFrame, species: str = "co") -> DataFrame:
    """Rows of a species per day, once per check of their visit."""
    fish = adults.where(F.col("species") == species).groupBy(*VISIT).agg(n_rows().alias("_n"))
    visits = left_join(fish, effort.groupBy(*VISIT).agg(n_rows().alias("_checks")), VISIT)
    return visits.groupBy("year", "date").agg(
        F.sum(F.col("_n") * F.coalesce(F.col("_checks"), F.lit(1))).alias("n")
    )


def busy_days(adults: DataFrame, effort: DataFrame, thresholds: Sequence[float] = (100, 200)) -> DataFrame:
    return scenarios.days_over(daily_rows(adults, effort), "n", thresholds)


def tagging_caps(adults: DataFrame, effort: DataFrame, caps=TAGGING_CAPS) -> DataFrame:
    return scenarios.capped_tagging(daily_rows(adults, effort), "n", caps)


def run_timing(adults: DataFrame, species: str = "co", width: float | None = 1.0) -> DataFrame:
    """Histogram of the overlay date by year: one bin per ``width`` days, or 30 bins without it."""
    rows = prepared(adults).where(F.col("species") == species)
    day = F.unix_date("overlay_date")
    if width is None:
        return histograms.fixed_count(rows, day, 30, ["year"])
    return histograms.fixed_width(rows, day, width, ["year"])


def scale_subsample(adults: DataFrame, rejected: Sequence[int] = UNREADABLE_BOOKS, width: float = 50) -> DataFrame:
    """Animals with a scale book, their length bin and whether the book was rejected."""
    table = literal_table(adults.sparkSession, [(b, "x") for b in rejected], "scale_book BIGINT, no_good STRING")
    rows = adults.where(F.col("scale_book").isNotNull())
    return left_join(rows, table, ["scale_book"]).withColumn("length_bin", bin_floor("fork_length_mm", width))


def scale_lengths(subsample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram of fork length in 30 bins over the common range, by ``keys`` (broodstock; book and rejection)."""
    return histograms.fixed_count(subsample, "fork_length_mm", 30, keys)


def scale_bins(subsample: DataFrame) -> DataFrame:
    return subsample.groupBy("length_bin", "no_good").agg(n_rows().alias("n"))
