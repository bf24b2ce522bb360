"""Stratified models, yearly pooled estimates and the reduced-effort scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.dates import in_windows, weekday_number
from tallyweir.functions.missing import sum_known
from tallyweir.functions.numbers import round_even
from tallyweir.operators.histograms import fixed_width
from tallyweir.operators.joins import calendar_fill, left_join
from tallyweir.operators.recapture import auto_pool, rank_models, stratum_totals, with_abundance
from tallyweir.operators.stratified import candidate_models, fit_models
from tallyweir.session import materialise

# Pooling thresholds; codes of marked and wild animals; Wednesday to Saturday;
# trapping seasons of the three years with daily operation.
POOL_MINIMUM = {"released": 100.0, "recaps": 10.0}
MARKED_CODE, WILD_CODE = "co-a", "co-w"
COUNTED_CODES = ("co-f", "co-w", "co-a")
REDUCED_WEEKDAYS = (4, 5, 6, 7)
SEASONS = (("2020-05-04", "2020-07-15"), ("2021-05-03", "2021-06-25"), ("2022-05-02", "2022-07-06"))
#: Shares of a season's totals that a pool of rows or of columns must reach in :func:`pools_by_share`.
ROW_SHARES, COLUMN_SHARES = {"released": 0.1, "recaps": 0.1}, {"inspected": 0.1}
MODEL_NAMES = {"single": "Logical pooling to single row (LP)", "full": "Full weekly strata", "auto": "Auto (logical) pooling"}


def pools_by_share(strata: DataFrame, shares: dict[str, float], keys: Sequence[str] = ("iso_year",)) -> DataFrame:
    """Automatic pools whose minima are shares of the season's totals, so that they fit any size of study."""
    whole = Window.partitionBy(*keys)
    least = {f"_least_{m}": F.sum(m).over(whole) * share for m, share in shares.items()}
    pooled = auto_pool(strata.withColumns(least), {m: F.col(f"_least_{m}") for m in shares}, keys)
    return pooled.drop(*least)


def candidate_cells(
    matrix: DataFrame, keys: Sequence[str] = ("iso_year",), minimum: dict[str, float] = POOL_MINIMUM,
    shares: dict[str, float] | None = None,
) -> DataFrame:
    """The cells of three models per season: one pool, every week its own pool, and automatic pooling (by totals, or by shares)."""
    matrix = materialise(matrix)  # weekly cells; used by three models and by the pooling rule
    strata = stratum_totals(matrix, keys)
    pools = auto_pool(strata, minimum, keys) if shares is None else pools_by_share(strata, shares, keys)
    models = {MODEL_NAMES["single"]: "single", MODEL_NAMES["full"]: "full", MODEL_NAMES["auto"]: pools}
    return candidate_models(matrix, models, keys)


def candidate_fits(
    matrix: DataFrame, keys: Sequence[str] = ("iso_year",), minimum: dict[str, float] = POOL_MINIMUM,
    shares: dict[str, float] | None = None,
) -> DataFrame:
    """The fits of :func:`candidate_cells`."""
    return fit_models(candidate_cells(matrix, keys, minimum, shares), keys)


def interior_only(fits: DataFrame) -> DataFrame:
    """Column ``interior``, and no estimates where it is false.

    A rate on its boundary makes the information matrix, and with it the criterion and the standard error, invalid; an interval
    for such a fit comes from :func:`tallyweir.operators.bootstrap.abundance_intervals`.
    """
    inside = F.coalesce(F.col("converged") & ~F.col("boundary"), F.lit(False))
    estimates = ("log_lik", "aicc", "gof_chisq", "gof_p", "n_hat", "n_hat_se", "capture_p")
    return fits.withColumn("interior", inside).withColumns({c: F.when(F.col("interior"), F.col(c)) for c in estimates})


def model_report(fits: DataFrame, keys: Sequence[str] = ("iso_year",)) -> DataFrame:
    """Comparison table, best model first."""
    ranked = rank_models(fits, keys)
    return ranked.select(
        *keys, "rank", "model_id", "n_rows", "n_cols", "aicc", "delta_aicc",
        round_even("gof_chisq", 1).alias("gof_chisq"), "gof_df", round_even("gof_p", 3).alias("gof_p"),
        round_even("n_hat").alias("n_hat"), round_even("n_hat_se").alias("n_hat_se"),
    ).orderBy(*keys, "rank")


def best_model(report: DataFrame) -> DataFrame:
    return report.where(F.col("rank") == 1)


def catch_by_origin(rows: DataFrame, year: str = "year", weight: str | None = None) -> DataFrame:
    """Rows of marked, of marked or wild, and of wild animals per year."""
    w = F.col(weight) if weight else F.lit(1)
    marked, wild = F.col("species") == MARKED_CODE, F.col("species") == WILD_CODE

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, w)), F.lit(0)).cast("bigint")

    return rows.groupBy(year).agg(
        total(marked).alias("marked_caught"), total(marked | wild).alias("total_caught"), total(wild).alias("wild_caught")
    )


def yearly_abundance(fish: DataFrame, releases: DataFrame, year: str = "year") -> DataFrame:
    """Pooled estimate per year from the number of marked animals released."""
    caught = catch_by_origin(fish, year)
    return with_abundance(left_join(caught, releases, [year]), "cwt_released", "total_caught", "marked_caught")


def reduced_days(
    days: DataFrame, seasons: Sequence[tuple[str, str]] = SEASONS, weekdays: Sequence[int] = REDUCED_WEEKDAYS
) -> DataFrame:
    """Calendar dates inside a season on the chosen weekdays (Sunday is 1)."""
    return days.where(in_windows("date", seasons) & weekday_number("date").isin(list(weekdays)))


def reduced_effort_abundance(
    fish: DataFrame,
    releases: DataFrame,
    days: DataFrame,
    seasons: Sequence[tuple[str, str]] = SEASONS,
    weekdays: Sequence[int] = REDUCED_WEEKDAYS,
) -> DataFrame:
    """The yearly estimate as if only some weekdays had been trapped."""
    per_day = fish.groupBy("date", "species").agg(F.count(F.lit(1)).alias("_n"))
    chosen = reduced_days(days, seasons, weekdays)
    filled = calendar_fill(chosen, per_day).withColumns(
        {"species": F.coalesce("species", F.lit("NFC")), "year": F.year("date")}
    )
    caught = catch_by_origin(filled.where(F.col("species").isin(list(COUNTED_CODES))), "year", "_n")
    return with_abundance(left_join(caught, releases, ["year"]), "cwt_released", "total_caught", "marked_caught")


def reduced_effort_histogram(
    fish: DataFrame, days: DataFrame, seasons: Sequence[tuple[str, str]] = SEASONS, weekdays: Sequence[int] = REDUCED_WEEKDAYS,
    width: float = 5, date: str = "overlay_date",
) -> DataFrame:
    """Rows of the counted species on the chosen days per bin of the overlay date, by species and year."""
    chosen = reduced_days(days, seasons, weekdays).select("date")
    rows = fish.where(F.col("species").isin(list(COUNTED_CODES))).join(chosen, "date", "left_semi")
    return fixed_width(rows.withColumn("year", F.year("date")), F.unix_date(date), width, ["year", "species"])


def season_proportions(fish: DataFrame, year: str = "year") -> DataFrame:
    """Share of the season's wild and marked animals seen on each day."""
    daily = catch_by_origin_daily(fish, year)
    season = daily.groupBy(year).agg(F.sum("wild").alias("_wild"), F.sum("marked").alias("_marked"))
    out = left_join(daily, season, [year])
    return (
        out.withColumn("share_wild", F.try_divide("wild", "_wild"))
        .withColumn("share_marked", F.try_divide("marked", "_marked"))
        .drop("_wild", "_marked")
    )


def catch_by_origin_daily(fish: DataFrame, year: str = "year") -> DataFrame:
    rows = fish.where(F.col("species").isin(WILD_CODE, MARKED_CODE))
    return rows.groupBy(year, "date").agg(
        sum_known(F.when(F.col("species") == WILD_CODE, F.col("count"))).alias("wild"),
        sum_known(F.when(F.col("species") == MARKED_CODE, F.col("count"))).alias("marked"),
    )
