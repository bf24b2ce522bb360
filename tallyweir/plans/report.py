"""Season report tables: species, sizes, ages, growth, condition, mortality, data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions import dates
from tallyweir.functions.missing import blank_to_null, keep_in, recode, sum_known
from tallyweir.functions.numbers import condition_factor, length_class
from tallyweir.operators import biology, checks, histograms, regression, scenarios
from tallyweir.operators.joins import inner_join, left_join
from tallyweir.operators.ordering import by_levels, sort_missing_last
from tallyweir.operators.reshape import to_wide

# Display names of the species codes, their report order, size classes in order,
# age codes in use, and the life stage kept from the age records.
SPECIES_NAMES = {
    "co-w": "Coho (wild)",
    "st/rb": "Steelhead or Rainbow trout",
    "co-a": "Coho (hatchery)",
    "bt/dv": "Bull trout or Dolly varden",
    "ct": "Cutthroat",
    "mw": "Mountain whitefish",
    "ch": "Chinook",
    "pk": "Pink",
}
CLIPPED_SPECIES_NAMES = {
    **{k: v for k, v in SPECIES_NAMES.items() if k != "co-a"},
    "co-w.r": "Coho (wild) recap",
    "co-h": "Coho (hatchery)",
}
SPECIES_ORDER = (
    "Coho (wild)",
    "Coho (hatchery)",
    "Steelhead or Rainbow trout",
    "Bull trout or Dolly varden",
    "Cutthroat",
    "Mountain whitefish",
    "Chinook",
    "Pink",
)
SIZE_ORDER = ("little", "small", "big", "bigger", "biggest")
AGE_CODES = ("22", "33", "44")
JUVENILE = "Juvenile"
WILD, HATCHERY = "Coho (wild)", "Coho (hatchery)"


def labelled(fish: DataFrame) -> DataFrame:
    """Numbers from text, flags in lower case with "no" for missing, species by display name."""
    return fish.withColumns(
        {
            "count": F.col("count").try_cast("double"),
            "mort": F.lower(F.coalesce("mort", F.lit("no"))),
            "sacrifice": F.lower(F.coalesce("sacrifice", F.lit("no"))),
            "species": recode("species", SPECIES_NAMES),
        }
    )


def species_totals(fish: DataFrame, excluded: str = "co-f") -> DataFrame:
    """Totals per species in report order; species outside the order come last."""
    rows = labelled(fish).where(F.col("species") != excluded)
    totals = rows.groupBy("species").agg(sum_known("count").alias("total"))
    return totals.orderBy(*by_levels("species", SPECIES_ORDER))


def species_by_site(fish: DataFrame, sites: Sequence[str] = ("barn", "fence")) -> DataFrame:
    """One column per site and one for any other, largest downstream catch first."""
    named = fish.withColumn("species", recode("species", CLIPPED_SPECIES_NAMES))
    wide = to_wide(named, ["species"], "site", sites, sum_known("count"))
    return sort_missing_last(wide, sites[-1], descending=True)


def daily_by_site(fish: DataFrame, species: str = "co-w", sites: Sequence[str] = ("barn", "fence")) -> DataFrame:
    rows = keep_in(fish.where(F.col("species") == species), "site", sites)
    return rows.groupBy("date", "site").agg(sum_known("count").alias("n"))


def size_class_totals(fish: DataFrame, species: str = "co-w") -> DataFrame:
    rows = fish.where((F.col("species") == species) & F.col("size_cwt").isNotNull())
    totals = rows.groupBy("size_cwt").agg(sum_known("count").alias("total"))
    return totals.orderBy(*by_levels("size_cwt", SIZE_ORDER))


def _aged(fish: DataFrame, species: str) -> DataFrame:
    rows = fish.where(F.col("species") == species)
    return rows.select("fork_length_mm", blank_to_null("gr_age").try_cast("int").alias("age"))


def age_length_key(fish: DataFrame, species: str = "co-w", width: float = 5.0) -> DataFrame:
    aged = _aged(fish, species).where(F.col("age").isin([int(a) for a in AGE_CODES]))
    return biology.age_length_key(aged, "fork_length_mm", "age", width)


def expected_ages(fish: DataFrame, species: str = "co-w", width: float = 5.0) -> DataFrame:
    """Unaged animals spread over the ages by the key of their length bin."""
    unaged = fish.where((F.col("species") == species) & blank_to_null("gr_age").isNull())
    return biology.apply_age_length_key(unaged, age_length_key(fish, species, width), "fork_length_mm", "age", width)


def _aged_rows(fish: DataFrame, species: str) -> DataFrame:
    """Animals of a species with a numeric age beside their columns, and only those in use as codes."""
    rows = fish.where(F.col("species") == species).withColumn("age", blank_to_null("gr_age").try_cast("int"))
    return rows.where(F.col("age").isin([int(a) for a in AGE_CODES]))


def ages_of_unaged(fish: DataFrame, species: str = "co-w", width: float = 5.0, length: str = "fork_length_mm") -> DataFrame:
    """An age for every unaged animal, from the key of the aged ones."""
    key = biology.age_length_key(_aged_rows(fish, species), length, "age", width)
    unaged = fish.where((F.col("species") == species) & blank_to_null("gr_age").isNull() & F.col(length).isNotNull())
    return biology.assigned_ages(unaged, key, length, "age", width, ["row_label"])


def with_growth_correction(fish: DataFrame, species: str = "co-w") -> DataFrame:
    """Lengths as of the mean day of the season's aged animals (``corrected_length``)."""
    return biology.growth_corrected(fish, _aged_rows(fish, species), "fork_length_mm", F.dayofyear("date"), "age")


def condition_band(fish: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """:func:`condition_over_season` with its standard error."""
    return regression.local_band(fish, F.dayofyear("date"), "k", keys)


def length_by_age_band(fish: DataFrame, shortest: float = 70.0, points: int = 20) -> DataFrame:
    """The lines of :func:`length_by_age_lines` on an even grid over the dates of each age, with standard errors."""
    rows = keep_in(fish, "gr_age", AGE_CODES).where(F.col("fork_length_mm") >= shortest)
    fits = regression.line_fit(rows, F.unix_date("date"), "fork_length_mm", ["gr_age"])
    span = rows.groupBy("gr_age").agg(F.min(F.unix_date("date")).alias("_lo"), F.max(F.unix_date("date")).alias("_hi"))
    grid = left_join(fits, span, ["gr_age"]).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / float(points - 1)
    return regression.line_band(grid, at).select("gr_age", "x", "fitted", "se_fitted")


def _measured(fish: DataFrame, species: Sequence[str]) -> DataFrame:
    rows = keep_in(fish, "species", species)
    return rows.where((F.col("weight_g") > 0) & (F.col("fork_length_mm") > 0))


def weight_length_fit(fish: DataFrame, species: Sequence[str] = ("co-w", "co-a")) -> DataFrame:
    rows = _measured(fish, species)
    return regression.line_fit(rows, F.log10("fork_length_mm"), F.log10("weight_g"))


def predicted_weight(fit: DataFrame, lengths: Sequence[float]) -> DataFrame:
    """Weights on the fitted curve at the given lengths."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in lengths]))
    out = fit.select("intercept", "slope", at.alias("length"))
    return out.select("length", regression.power_law("length", F.col("intercept"), F.col("slope")).alias("weight"))


def condition_values(fish: DataFrame, species: str = "co-w") -> DataFrame:
    return _measured(fish, [species]).withColumn("k", condition_factor("weight_g", "fork_length_mm"))


def condition_summary(fish: DataFrame, species: str = "co-w") -> DataFrame:
    return biology.distribution_summary(condition_values(fish, species), "k")


def condition_histogram(fish: DataFrame, species: str = "co-w", width: float = 0.05) -> DataFrame:
    return histograms.fixed_width(condition_values(fish, species), "k", width)


def low_condition(fish: DataFrame, below: float = 0.7) -> DataFrame:
    """Animals to look at again (needs ``k``)."""
    return fish.where(F.col("k") < below).select("row_label", "date", "fork_length_mm", "k")


def condition_over_season(fish: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Smoothed condition factor by day of the season (needs ``k``)."""
    return regression.local_smoother(fish, F.dayofyear("date"), "k", keys)


def length_by_age_lines(fish: DataFrame, shortest: float = 70.0) -> DataFrame:
    """Length against date, one line per age."""
    rows = keep_in(fish, "gr_age", AGE_CODES).where(F.col("fork_length_mm") >= shortest)
    return regression.line_fit(rows, F.unix_date("date"), "fork_length_mm", ["gr_age"])


def length_by_age_model(fish: DataFrame) -> DataFrame:
    """Length against date with a common slope and an effect per age."""
    return regression.factor_line_fit(
        keep_in(fish, "gr_age", AGE_CODES), F.unix_date("date"), "fork_length_mm", "gr_age"
    )


def mortality(fish: DataFrame, excluded: str | None = "co-f", replace: bool = False) -> DataFrame:
    """Mortality per species; the hatchery line (all sacrificed) is appended."""
    rows = labelled(fish)
    if excluded is not None:
        rows = rows.where(F.col("species") != excluded)
    table = biology.mortality_table(
        rows, "species", F.col("mort") == "yes", F.col("sacrifice") == "yes",
        all_sacrificed=(HATCHERY,), replace=replace,
    )
    return table.orderBy(*by_levels("species", (WILD, HATCHERY)))


def peak_day(fish: DataFrame, species: str = "co-w", keys: Sequence[str] = ()) -> DataFrame:
    daily = fish.where(F.col("species") == species).groupBy(*keys, "date").agg(sum_known("count").alias("n"))
    return biology.peak_and_trough(daily, "n", keys)


def trap_season(effort: DataFrame) -> DataFrame:
    """Season dates, days and hours from visits whose clock times carry no usable date."""
    timed = effort.withColumns(
        {
            "year": F.year("date"),
            "arrival": dates.with_time_of_day("date", "arrival_time_24h"),
            "departure": dates.with_time_of_day("date", "departure_time_24h"),
        }
    ).withColumn("minutes", dates.minutes_between("arrival", "departure"))
    return scenarios.season_summary(timed, ["year"], minutes="minutes")


def double_marked(fish: DataFrame) -> DataFrame:
    return checks.both_set(fish, "a_adclip", "r_adclip")


def size_mismatch(fish: DataFrame, species: str = "co-w") -> DataFrame:
    """Recorded size class against the one its length implies."""
    rows = fish.where(F.col("species") == species).select("date", "site", "fork_length_mm", "size_cwt")
    rows = rows.withColumn("size_computed", length_class("fork_length_mm"))
    rows = rows.withColumn("size_cwt", F.coalesce("size_cwt", "size_computed"))
    return checks.label_mismatch(rows, "size_cwt", "size_computed")


def age_records(ages: DataFrame, years: Sequence[int] | None = None, stage: str = JUVENILE) -> DataFrame:
    """Age readings of some years (all if none are named) and a life stage, with a numeric scale number."""
    dated = ages.withColumn("year", F.year("start_date"))
    chosen = dated if years is None else keep_in(dated, "year", years)
    rows = keep_in(chosen, "life_stage", [stage])
    return rows.withColumn("scale_number", F.col("address").try_cast("bigint"))


def aged_fish(fish: DataFrame, ages: DataFrame) -> DataFrame:
    """Fish with an age reading of their year and scale number."""
    rows = fish.where(F.col("scale_number").isNotNull())
    return inner_join(rows, ages.select("year", "scale_number", "eu_age", "age_code"), ["year", "scale_number"])


def fish_without_age_code(fish: DataFrame, ages: DataFrame) -> DataFrame:
    """Fish that have no age reading, or one without a code."""
    codes = ages.select("year", "scale_number", "eu_age", "age_code")
    return left_join(fish, codes, ["year", "scale_number"]).where(F.col("age_code").isNull())
