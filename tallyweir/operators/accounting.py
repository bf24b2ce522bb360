"""Tag retention, release accounting and reallocation of unreadable marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.missing import mean_or, ratio, ratio_or, sum_known, sum_strict
from tallyweir.functions.numbers import round_even
from tallyweir.operators.joins import left_join


def retention_rates(
    checks: DataFrame,
    keys: Sequence[str],
    retained: str = "r_retention_n",
    sample: str = "r_sample_size",
    *,
    counts: bool = False,
    retagged: str | None = None,
) -> DataFrame:
    """Mean of the per-check retention ratios by key; 1 where no check was made.

    A mean of ratios, not a ratio of sums: every check weighs the same. ``counts`` adds the pooled
    numbers checked and retained; ``retagged`` adds the strict total of that column.
    """
    measures = [mean_or(ratio(retained, sample), 1.0).alias("retention")]
    if counts:
        measures = [sum_known(sample).alias("n"), sum_known(retained).alias("n_retained"), *measures]
    if retagged:
        measures.append(sum_strict(retagged).alias("n_retagged"))
    return checks.groupBy(*keys).agg(*measures)


def apply_overrides(
    rates: DataFrame, overrides: DataFrame, rate: str = "retention", code: str = "tag_code", week: str = "iso_week",
    order: str | None = None,
) -> DataFrame:
    """Replace rates by exception. An override without a code holds for its whole week and wins.

    Of several overrides for one key the last one holds: by ``order``, or as listed in a typed-in table.
    """
    listed = overrides.withColumn("_order", F.col(order) if order else F.monotonically_increasing_id())
    last = F.max_by("rate", "_order")
    by_week = listed.where(F.col(code).isNull()).groupBy(week).agg(last.alias("_week_rate"))
    by_code = listed.where(F.col(code).isNotNull()).groupBy(code, week).agg(last.alias("_code_rate"))
    out = left_join(rates, by_code, [code, week], null_safe=False)
    out = left_join(out, by_week, [week], null_safe=False)
    fixed = F.coalesce("_week_rate", "_code_rate", rate)
    return out.withColumn(rate, fixed).drop("_week_rate", "_code_rate")


def retag_totals(
    checks: DataFrame, keys: Sequence[str] = ("tag_code",), retagged: str = "r_re_tagged_n", only_positive: bool = True
) -> DataFrame:
    rows = checks.where(F.col(retagged) > 0) if only_positive else checks
    return rows.groupBy(*keys).agg(sum_strict(retagged).alias("n_retagged"))


def release_summary(batches: DataFrame, keys: Sequence[str], injected: Column, rate: str = "retention") -> DataFrame:
    """Injected, estimated retained (rounded half to even) and estimated lost per key."""
    held = batches.withColumn("_inj", injected).withColumn("_kept", F.col("_inj") * F.col(rate))
    sums = held.groupBy(*keys).agg(sum_strict("_inj").alias("injected"), sum_strict("_kept").alias("_kept"))
    return (
        sums.withColumn("est_retained", round_even("_kept"))
        .withColumn("est_lost", F.col("injected") - F.col("est_retained"))
        .drop("_kept")
    )


def net_releases(
    summary: DataFrame, retags: DataFrame, keys: Sequence[str] = ("tag_code",), retag_null_as_zero: bool = True
) -> DataFrame:
    """Add re-tagged fish to the retained ones. Without the zero fill a missing retag stays unknown."""
    out = left_join(summary, retags, keys)
    again = F.coalesce("n_retagged", F.lit(0.0)) if retag_null_as_zero else F.col("n_retagged")
    return out.withColumn("n_retagged", again).withColumn(
        "net_releases", F.col("est_retained") + F.col("n_retagged")
    )


def retention_percent(summary: DataFrame, name: str = "percent_retention") -> DataFrame:
    share = round_even(ratio("est_retained", "injected"), 2)
    return summary.withColumn(name, share * 100)


def reallocate_unknown(
    df: DataFrame,
    first: str,
    second: str,
    unknown: str,
    week: str,
    start_week: int,
    inclusive: bool = True,
    only: Column | None = None,
) -> DataFrame:
    """Give unreadable marks to the two readable kinds in their proportion, from a start week on.

    The two rounded parts need not add up; what is left over (or overdrawn) stays in ``unknown``.
    Rows for which ``only`` does not hold are left as they are.
    """
    open_now = F.col(week) >= start_week if inclusive else F.col(week) > start_week
    if only is not None:
        open_now = open_now & only
    portion = ratio_or(first, F.col(first) + F.col(second), 0.0)
    out = df.withColumn("_p", portion)
    given = {
        "_to_first": F.when(open_now, round_even(F.col(unknown) * F.col("_p"))).otherwise(0.0),
        "_to_second": F.when(open_now, round_even(F.col(unknown) * (1 - F.col("_p")))).otherwise(0.0),
    }
    return (
        out.withColumns(given)
        .withColumn(first, F.col(first) + F.col("_to_first"))
        .withColumn(second, F.col(second) + F.col("_to_second"))
        .withColumn(unknown, F.col(unknown) - (F.col("_to_first") + F.col("_to_second")))
        .drop("_p", "_to_first", "_to_second")
    )
