"""Condition, size, age and mortality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.missing import n_rows, ratio, sum_known, sum_where
from tallyweir.functions.numbers import bin_floor, percent_text, round_even
from tallyweir.operators.aggregates import contingency, exact_quantiles
from tallyweir.operators.joins import left_join, small_side
from tallyweir.operators.ordering import with_row_id
from tallyweir.operators.reshape import append


def size_summary(fish: DataFrame, keys: Sequence[str], digits: int | None = 1) -> DataFrame:
    """Rows, measured rows, mean and sample SD of length and weight."""
    def shown(c: Column) -> Column:
        return c if digits is None else round_even(c, digits)

    return fish.groupBy(*keys).agg(
        n_rows().alias("n_rows"),
        F.count("fork_length_mm").alias("n_measured"),
        shown(F.avg("fork_length_mm")).alias("mean_length"),
        shown(F.stddev_samp("fork_length_mm")).alias("sd_length"),
        shown(F.avg("weight_g")).alias("mean_weight"),
        shown(F.stddev_samp("weight_g")).alias("sd_weight"),
    )


def distribution_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, SD, minimum, quartiles and maximum."""
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    basic = (known.groupBy(*keys) if keys else known).agg(
        n_rows().alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(known, value, (0.25, 0.5, 0.75), keys).select(
        *keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    # one row per group on each side: stacked and folded, which also works without keys
    both = append(basic, quartiles, fill_missing=True)
    shown = ("n", "mean", "sd", "min", "q1", "median", "q3", "max")
    return (both.groupBy(*keys) if keys else both).agg(*[F.max(c).alias(c) for c in shown])


def age_length_key(aged: DataFrame, length: str, age: str, width: float) -> DataFrame:
    """Counts and shares of the ages within each length bin."""
    return contingency(aged.withColumn("length_bin", bin_floor(length, width)), "length_bin", age)


def apply_age_length_key(unaged: DataFrame, key: DataFrame, length: str, age: str, width: float) -> DataFrame:
    """Expected number of unaged animals per age, from their length bins."""
    counts = (
        unaged.withColumn("length_bin", bin_floor(length, width)).where(F.col("length_bin").isNotNull())
        .groupBy("length_bin").agg(n_rows().alias("_unaged"))
    )
    joined = left_join(counts, key, ["length_bin"], null_safe=False).where(F.col(age).isNotNull())
    return joined.groupBy(age).agg(F.sum(F.col("_unaged") * F.col("share")).alias("expected_n"))


def apportioned_ages(unaged: DataFrame, key: DataFrame, length: str, age: str, width: float) -> DataFrame:
    """Whole numbers of unaged animals per length bin and age: columns length_bin, ``age``, n_ages, from_rank, to_rank.

    The expected numbers are cut to whole ones and what is left of a bin goes to the ages with the largest remainders (the
    younger of equals), so a bin's numbers add up to its animals. Ranks run from 1 inside a bin, younger ages first.
    """
    counts = (
        unaged.withColumn("length_bin", bin_floor(length, width)).where(F.col("length_bin").isNotNull())
        .groupBy("length_bin").agg(n_rows().alias("_unaged"))
    )
    share = F.col("_unaged") * F.col("n")  # of row_total; whole numbers, so remainders compare exactly
    joined = left_join(counts, key, ["length_bin"], null_safe=False).where(F.col(age).isNotNull())
    cut = joined.withColumns({"_whole": F.floor(share / F.col("row_total")), "_left": F.pmod(share, "row_total")})
    same, by_age = Window.partitionBy("length_bin"), Window.partitionBy("length_bin").orderBy(age)
    spare = F.col("_unaged") - F.sum("_whole").over(same)
    order = F.row_number().over(same.orderBy(F.col("_left").desc(), age))
    filled = cut.withColumn("n_ages", F.col("_whole") + F.when(order <= spare, 1).otherwise(0))
    to = F.sum("n_ages").over(by_age.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return filled.select("length_bin", age, "n_ages", (to - F.col("n_ages") + 1).alias("from_rank"), to.alias("to_rank"))


def assigned_ages(
    unaged: DataFrame, key: DataFrame, length: str, age: str, width: float, order: Sequence[str], name: str = "assigned_age"
) -> DataFrame:
    """``unaged`` with an age for every animal, in the numbers of :func:`apportioned_ages`.

    Inside a bin the longer animals get the older ages; ``order`` names columns that, after the length, make the order
    unique. The ranks come from row numbers over all animals less the first of the bin, so a bin with very many animals is
    spread over tasks. Animals without a length, or in a bin without aged ones, have no age.
    """
    binned = unaged.withColumn("length_bin", bin_floor(length, width))
    numbered = with_row_id(binned, ["length_bin", length, *order], "_row")
    first = numbered.groupBy("length_bin").agg(F.min("_row").alias("_first"))
    ranges = apportioned_ages(unaged, key, length, age, width).where("n_ages > 0").withColumnRenamed(age, name)
    placed = ranges.join(first, "length_bin").select(
        F.col("length_bin").alias("_bin"), name, (F.col("_first") + F.col("from_rank") - 1).alias("_from"), (F.col("_first") + F.col("to_rank") - 1).alias("_to"))
    inside = (F.col("length_bin") == F.col("_bin")) & F.col("_row").between(F.col("_from"), F.col("_to"))
    return numbered.join(small_side(placed), inside, "left").select(*unaged.columns, "length_bin", name)


def growth_corrected(
    fish: DataFrame, aged: DataFrame, length: str, day: Column, age: str, keys: Sequence[str] = ("year",), name: str = "corrected_length"
) -> DataFrame:
    """``fish`` with the length each animal would have on the season's mean day of the aged ones.

    Growth per day is the slope common to the ages of a season: within-age moments are added up, so no age's mean counts.
    A season without a slope keeps its lengths.
    """
    pairs = aged.select(*keys, age, day.cast("double").alias("_x"), F.col(length).cast("double").alias("_y")).dropna()
    n = F.count(F.lit(1)).cast("double")
    levels = pairs.groupBy(*keys, age).agg(
        n.alias("_n"), F.avg("_x").alias("_mx"), (F.var_pop("_x") * n).alias("_sxx"), (F.covar_pop("_x", "_y") * n).alias("_sxy"))
    seasons = levels.groupBy(*keys).agg(
        ratio(F.sum("_sxy"), F.sum("_sxx")).alias("_growth"), (F.sum(F.col("_n") * F.col("_mx")) / F.sum("_n")).alias("_day"))
    joined = left_join(fish, small_side(seasons), list(keys))
    moved = F.col(length) - F.coalesce(F.col("_growth") * (day - F.col("_day")), F.lit(0.0))
    return joined.withColumn(name, moved).drop("_growth", "_day")


def mortality_table(
    fish: DataFrame,
    group: str,
    accidental: Column,
    sacrificed: Column,
    count: str = "count",
    all_sacrificed: Sequence[str] = (),
    replace: bool = False,
) -> DataFrame:
    """Accidental and deliberate mortality per group, with percentages as text.

    Groups without mortality are left out. Groups in ``all_sacrificed`` get a line of their own
    (all animals sacrificed); it is added to an existing line unless ``replace`` is set.
    """
    totals = fish.groupBy(group).agg(
        sum_known(count).alias("total"),
        sum_where(accidental, count).alias("accidental"),
        sum_where(sacrificed, count).alias("sacrificed"),
    )
    listed = F.coalesce(F.col(group).isin(list(all_sacrificed)), F.lit(False))
    affected = (F.col("accidental") > 0) | (F.col("sacrificed") > 0)
    own_line = F.struct(
        F.col("accidental").alias("accidental"),
        F.col("sacrificed").alias("sacrificed"),
        percent_text(round_even(ratio("accidental", "total") * 100, 2)).alias("percent_accidental"),
        percent_text(round_even(ratio("sacrificed", "total") * 100, 2)).alias("percent_sacrificed"),
    )
    full_line = F.struct(
        F.lit(0.0).alias("accidental"),
        F.col("total").alias("sacrificed"),
        F.lit("0%").alias("percent_accidental"),
        F.lit("100%").alias("percent_sacrificed"),
    )
    # both kinds of line come from the one aggregate, so the observations are read once
    lines = F.array(F.when(affected & ~listed if replace else affected, own_line), F.when(listed, full_line))
    return (
        totals.select(group, "total", F.explode(lines).alias("_line")).where(F.col("_line").isNotNull())
        .select(group, "total", "_line.*")
    )


def peak_and_trough(daily: DataFrame, value: str, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Day of the largest and of the smallest total (the earliest when tied)."""
    high = F.min_by(F.struct(date, value), F.struct(-F.col(value), F.col(date)))
    low = F.min_by(F.struct(date, value), F.struct(F.col(value), F.col(date)))
    known = daily.where(F.col(value).isNotNull())
    grouped = known.groupBy(*keys) if keys else known
    return grouped.agg(high.alias("_h"), low.alias("_l")).select(
        *keys,
        F.col(f"_h.{date}").alias("peak_date"), F.col(f"_h.{value}").alias("peak_n"),
        F.col(f"_l.{date}").alias("low_date"), F.col(f"_l.{value}").alias("low_n"),
    )
