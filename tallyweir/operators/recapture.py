"""Mark-recapture estimators, the release by recovery matrix, pooling and model ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.missing import col, ratio, sum_where
from tallyweir.functions.numbers import round_even
from tallyweir.operators.reshape import to_wide
from tallyweir.operators.joins import left_join

# Fixed value: normal quantile of a two-sided 95 % interval.
NORMAL_95 = 1.96


def chapman(n1: str | Column, n2: str | Column, m2: str | Column) -> Column:
    """Chapman's abundance: nearly unbiased, defined for zero recaptures."""
    n1, n2, m2 = (col(x).cast("double") for x in (n1, n2, m2))
    return (n1 + 1) * (n2 + 1) / (m2 + 1) - 1


def chapman_variance(n1: str | Column, n2: str | Column, m2: str | Column) -> Column:
    n1, n2, m2 = (col(x).cast("double") for x in (n1, n2, m2))
    return (n1 + 1) * (n2 + 1) * (n1 - m2) * (n2 - m2) / ((m2 + 1) * (m2 + 1) * (m2 + 2))


def lincoln_petersen(n1: str | Column, n2: str | Column, m2: str | Column) -> Column:
    return ratio(col(n1).cast("double") * col(n2).cast("double"), m2)


def with_abundance(df: DataFrame, n1: str, n2: str, m2: str) -> DataFrame:
    """Closed-population estimates for every row of marked, caught and recaptured totals."""
    return (
        df.withColumn("lincoln_petersen", lincoln_petersen(n1, n2, m2))
        .withColumn("chapman", chapman(n1, n2, m2))
        .withColumn("variance", chapman_variance(n1, n2, m2))
        .withColumn("std_error", F.sqrt(F.greatest("variance", F.lit(0.0))))
        .withColumn("cv_percent", ratio("std_error", "chapman") * 100)
        .withColumn("half_width_95", F.col("std_error") * NORMAL_95)
        .withColumn("lower_95", F.col("chapman") - F.col("half_width_95"))
        .withColumn("upper_95", F.col("chapman") + F.col("half_width_95"))
    )


def trap_efficiency(caught: str, abundance: str) -> Column:
    """Catch of the second site as a percentage of the estimate."""
    return ratio(caught, abundance) * 100


def two_sample_counts(
    df: DataFrame, marked: Column, caught: Column, recaptured: Column, count: str | Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Marked, caught and recaptured totals in one pass over the observations."""
    totals = [
        sum_where(marked, count).alias("marked"),
        sum_where(caught, count).alias("caught"),
        sum_where(recaptured, count).alias("recaptured"),
    ]
    return df.groupBy(*keys).agg(*totals) if keys else df.agg(*totals)


# ---- release by recovery matrix ---------------------------------------------------------


def release_recovery_matrix(
    releases: DataFrame,
    recoveries: DataFrame,
    unmarked: DataFrame,
    keys: Sequence[str] = (),
    max_lag_weeks: int = 1,
) -> DataFrame:
    """Long release-week by recovery-week matrix from weekly totals per batch mark.

    Inputs are weekly aggregates: ``(keys, week, mark, n)`` twice and ``(keys, week, n)``, with
    ``week`` the Monday. A recovery belongs to a release of the same mark at most
    ``max_lag_weeks`` back; when several weeks qualify it is split in proportion to their
    releases and flagged. Recoveries without any qualifying release are kept as ``unassigned``.

    Kinds of cell: ``recovered``, ``never`` (released, not seen again), ``unmarked`` (caught
    without a mark) and ``unassigned``.
    """
    keys = list(keys)
    zero = F.lit(0.0)
    stacked = releases.select(*keys, "mark", "week", F.col("n").cast("double").alias("_rel"), zero.alias("_seen")).unionByName(
        recoveries.select(*keys, "mark", "week", zero.alias("_rel"), F.col("n").cast("double").alias("_seen"))
    )
    weekly = stacked.groupBy(*keys, "mark", "week").agg(F.sum("_rel").alias("_rel"), F.sum("_seen").alias("_seen"))
    # frames by date, so that a week without any row is not mistaken for its neighbour
    weeks = Window.partitionBy(*keys, "mark").orderBy(F.unix_date("week"))
    lags = range(max_lag_weeks + 1)
    released = {f"_rel{k}": F.coalesce(F.sum("_rel").over(weeks.rangeBetween(-7 * k, -7 * k)), zero) for k in lags}
    total = sum((F.col(c) for c in released), zero)
    options = sum(((F.col(c) > 0).cast("int") for c in released), F.lit(0))
    placed = weekly.withColumns(released).withColumns({"_total": total, "_options": options})
    ahead = weeks.rangeBetween(0, 7 * max_lag_weeks)
    whole = F.coalesce(F.sum(F.when(F.col("_options") == 1, F.col("_seen"))).over(ahead), zero)
    part = F.coalesce(F.sum(F.when(F.col("_options") > 1, F.col("_seen") / F.col("_total"))).over(ahead), zero)
    placed = placed.withColumn("_never", F.col("_rel") - whole - F.col("_rel") * part)

    def cell(kind: str, release, recover, n, ambiguous=None):
        return F.struct(
            F.lit(kind).alias("kind"), release.cast("date").alias("release_week"), recover.cast("date").alias("recover_week"),
            n.alias("n"), (F.lit(False) if ambiguous is None else ambiguous).alias("ambiguous"),
        )

    week, seen, none = F.col("week"), F.col("_seen"), F.lit(None)
    several = F.col("_options") > 1
    options = [
        F.when(
            (seen > 0) & (F.col(f"_rel{k}") > 0),
            cell(
                "recovered", F.date_sub(week, 7 * k), week,
                F.when(several, seen * F.col(f"_rel{k}") / F.col("_total")).otherwise(seen), several,
            ),
        )
        for k in lags
    ]
    options.append(F.when((seen > 0) & (F.col("_options") == 0), cell("unassigned", none, week, seen)))
    options.append(F.when(F.col("_rel") > 0, cell("never", week, none, F.col("_never"))))
    cells = (
        placed.select(*keys, F.explode(F.array_compact(F.array(*options))).alias("_c")).select(*keys, "_c.*")
        .groupBy(*keys, "kind", "release_week", "recover_week")
        .agg(F.sum("n").alias("n"), F.max("ambiguous").alias("ambiguous"))
    )
    rest = unmarked.select(*keys, cell("unmarked", none, week, F.col("n").cast("double")).alias("_c")).select(*keys, "_c.*")
    return cells.unionByName(rest)


def two_way_table(
    matrix: DataFrame, columns: Sequence[str], label: Callable[[Column], Column], keys: Sequence[str] = (),
    never: str = "never", unmarked: str = "unmarked", total: str = "total",
) -> DataFrame:
    """The matrix as a table: a row per release week, one of unmarked animals, and both margins.

    ``label`` names a week; ``columns`` lists the recovery weeks, as labels, that get a column of their own, and weeks beside
    them are only in the margins. The margins come from grouping sets, so the cells are read once. Columns are the
    keys, ``release``, the listed labels, ``never`` (released, not seen again) and ``total``; empty cells are zero.
    """
    kind = F.col("kind")
    row = F.when(kind == "unmarked", unmarked).otherwise(label(F.col("release_week")))
    column = F.when(kind == "never", never).otherwise(label(F.col("recover_week")))
    cells = matrix.where(kind != "unassigned").select(*keys, row.alias("release"), column.alias("_c"), "n")
    by = [F.col(k) for k in [*keys, "release", "_c"]]
    own, n = by[: len(keys)], F.sum("n").alias("n")
    sets = cells.groupingSets([by, [*own, by[-2]], [*own, by[-1]], own], *by).agg(n, F.grouping("release").alias("_gr"), F.grouping("_c").alias("_gc"))
    named = sets.select(
        *keys, F.when(F.col("_gr") == 1, total).otherwise(F.col("release")).alias("release"),
        F.when(F.col("_gc") == 1, total).otherwise(F.col("_c")).alias("_c"), "n",
    )
    return to_wide(named, [*keys, "release"], "_c", [*columns, never, total], F.sum("n"), 0.0, other=None)


def stratum_totals(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Released and recaptured totals per release week, for the pooling rule."""
    mine = F.col("kind").isin("recovered", "never")
    return (
        matrix.where(mine).groupBy(*keys, F.col("release_week").alias("stratum"))
        .agg(F.sum("n").alias("released"), sum_where(F.col("kind") == "recovered", "n").alias("recaps"))
    )


def inspected_totals(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Animals looked at per recovery week, marked or not."""
    mine = F.col("kind").isin("recovered", "unmarked")
    return (
        matrix.where(mine).groupBy(*keys, F.col("recover_week").alias("stratum"))
        .agg(F.sum("n").alias("inspected"))
    )


def auto_pool(
    strata: DataFrame, minimum: dict[str, float | Column], keys: Sequence[str] = (), stratum: str = "stratum"
) -> DataFrame:
    """Pool label for each stratum (the first stratum of its pool).

    Strata are pooled inwards from both ends until every measure in ``minimum`` is reached; an
    interior stratum that falls short joins the one before it. Running totals over the (few)
    strata of a season express the rule.
    """
    by = list(keys) or [F.lit(0)]
    forward = Window.partitionBy(*by).orderBy(stratum).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = Window.partitionBy(*by).orderBy(F.col(stratum).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*by)
    enough_from_top, enough_from_end, enough_alone = F.lit(True), F.lit(True), F.lit(True)
    for measure, least in minimum.items():
        enough_from_top = enough_from_top & (F.sum(measure).over(forward) >= least)
        enough_from_end = enough_from_end & (F.sum(measure).over(backward) >= least)
        enough_alone = enough_alone & (F.col(measure) >= least)
    step = strata.withColumns({"_top": enough_from_top, "_end": enough_from_end, "_alone": enough_alone})
    # head pool: up to the first stratum that fills it; tail pool: from the last one that fills it
    step = step.withColumns(
        {
            "_head_end": F.coalesce(F.min(F.when(F.col("_top"), F.col(stratum))).over(whole), F.max(stratum).over(whole)),
            "_tail_start": F.coalesce(F.max(F.when(F.col("_end"), F.col(stratum))).over(whole), F.min(stratum).over(whole)),
        }
    )
    opens = (
        (F.col(stratum) > F.col("_head_end"))
        & (F.col(stratum) <= F.col("_tail_start"))
        & (F.col("_alone") | (F.col(stratum) == F.col("_tail_start")))
    )
    step = step.withColumn("_pool", F.sum(opens.cast("int")).over(forward))
    label = F.min(stratum).over(Window.partitionBy(*by, "_pool"))
    return step.withColumn("pool", label).drop("_top", "_end", "_alone", "_head_end", "_tail_start", "_pool")


def pool_matrix(
    matrix: DataFrame, row_pools: DataFrame, col_pools: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Physically pooled matrix: cells are added up under the pool labels ``(keys, stratum, pool)``."""
    keys = list(keys)
    out = matrix
    for axis, pools in (("release_week", row_pools), ("recover_week", col_pools)):
        if pools is None:
            continue
        names = pools.select(*keys, F.col("stratum").alias(axis), F.col("pool").alias("_pool"))
        out = left_join(out, names, [*keys, axis]).withColumn(axis, F.coalesce("_pool", axis)).drop("_pool")
    return out.groupBy(*keys, "release_week", "recover_week", "kind").agg(
        F.sum("n").alias("n"), F.max("ambiguous").alias("ambiguous")
    )


# ---- model comparison -------------------------------------------------------------------


def rank_models(report: DataFrame, keys: Sequence[str] = (), criterion: str = "aicc") -> DataFrame:
    """Difference to the best criterion value among the models of each season, and the rank.

    A model without a criterion (no fit, or one that has not converged) has no rank.
    """
    by = list(keys) or [F.lit(0)]
    delta = round_even(F.col(criterion) - F.min(criterion).over(Window.partitionBy(*by)), 2)
    order = Window.partitionBy(*by).orderBy(F.col(f"delta_{criterion}").asc_nulls_last(), "model_id")
    return report.withColumn(f"delta_{criterion}", delta).withColumn(
        "rank", F.when(F.col(criterion).isNotNull(), F.row_number().over(order))
    )
