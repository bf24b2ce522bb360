"""Batch marks: weekly summaries, daily applied and recovered marks, release by recovery tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.dates import week_label, week_start
from tallyweir.functions.missing import in_set, strict_sum_where, sum_where
from tallyweir.operators.accounting import reallocate_unknown
from tallyweir.operators.aggregates import distinct_text
from tallyweir.operators.recapture import (
    release_recovery_matrix,
    trap_efficiency,
    two_sample_counts,
    with_abundance,
)
from tallyweir.operators.reshape import to_long, to_wide
from tallyweir.plans.canonical import BATCH_MARKS
from tallyweir.session import materialise

UPSTREAM, DOWNSTREAM = "barn", "fence"
MARKS = ("top", "bottom", "none")
DAY = ("iso_year", "iso_week", "year_day", "date")
# Fixed value: ISO week from which batch marks alternate, so unreadable ones can be attributed.
FIRST_MARK_WEEK = 19


def weekly_summary(fish: DataFrame, by_site: bool = False) -> DataFrame:
    """New marks, recaptures, unmarked, sacrificed and dead per week; marks used when by site."""
    keys = ["iso_year", "iso_week", "week_label", *(["site"] if by_site else [])]
    measures = [
        sum_where(in_set("tag_status", ["A"]), "count").alias("new_tags"),
        sum_where(in_set("tag_status", ["R"]), "count").alias("recaps"),
        sum_where(F.col("tag_status").isNull(), "count").alias("unmarked"),
        sum_where(F.col("fate") == "sacrifice", "count").alias("sacrifices"),
        sum_where(F.col("fate") == "mort", "count").alias("morts"),
    ]
    rows = fish.withColumn("week_label", week_label("date"))
    if not by_site:
        return rows.groupBy(*keys).agg(*measures)
    # hash-aggregate down to one row per combination of marks before any set is collected
    names = ("new_tags", "recaps", "unmarked", "sacrifices", "morts")
    per_mark = rows.groupBy(*keys, "a_caudalclip", "r_caudalclip").agg(*measures)
    return per_mark.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in names],
        distinct_text("a_caudalclip").alias("marks_applied"),
        distinct_text("r_caudalclip").alias("marks_recovered"),
    )


def sample_totals(
    fish: DataFrame, keys: Sequence[str] = (), site: str = "site", upstream: str = UPSTREAM, downstream: str = DOWNSTREAM
) -> DataFrame:
    """Marked upstream, caught downstream, recaptured downstream."""
    here = F.col(site) == downstream
    return two_sample_counts(
        fish,
        (F.col(site) == upstream) & in_set("tag_status", ["A"]),
        here,
        here & in_set("tag_status", ["R"]),
        "count",
        keys,
    )


def pooled_abundance(fish: DataFrame, keys: Sequence[str] = (), site: str = "site") -> DataFrame:
    """Closed-population estimate and efficiency of the downstream trap, one row per key."""
    out = with_abundance(sample_totals(fish, keys, site), "marked", "caught", "recaptured")
    return out.withColumn("trap_efficiency", trap_efficiency("caught", "chapman"))


def _by_mark(rows: DataFrame, mark: str, site: str) -> DataFrame:
    sums = [sum_where(in_set(mark, [m]), "count").alias(m) for m in MARKS]
    return rows.groupBy(*DAY, F.col(site).alias("site")).agg(*sums)


def daily_applied_wide(fish: DataFrame, site: str = "site") -> DataFrame:
    return _by_mark(fish.where((F.col(site) == UPSTREAM) & in_set("tag_status", ["A"])), "a_caudalclip", site)


def daily_recovered_wide(fish: DataFrame, start_week: int = FIRST_MARK_WEEK, inclusive: bool = True) -> DataFrame:
    rows = fish.where((F.col("site") == DOWNSTREAM) & in_set("tag_status", ["R"]))
    return reallocate_unknown(
        _by_mark(rows, "r_caudalclip", "site"), "top", "bottom", "none", "iso_week", start_week, inclusive
    )


def _long(wide: DataFrame) -> DataFrame:
    return to_long(wide, [*DAY, "site"], MARKS, "mark", "n")


def daily_applied(fish: DataFrame, site: str = "site") -> DataFrame:
    return _long(daily_applied_wide(fish, site))


def daily_recovered(fish: DataFrame, start_week: int = FIRST_MARK_WEEK, inclusive: bool = True) -> DataFrame:
    return _long(daily_recovered_wide(fish, start_week, inclusive))


def applied_and_recovered(fish: DataFrame, start_week: int = FIRST_MARK_WEEK, inclusive: bool = True) -> DataFrame:
    """Both series in one long table, from one pass: the site tells which mark column counts."""
    applied = (F.col("site") == UPSTREAM) & in_set("tag_status", ["A"])
    returned = (F.col("site") == DOWNSTREAM) & in_set("tag_status", ["R"])
    mark = F.when(applied, F.col("a_caudalclip")).otherwise(F.col("r_caudalclip"))
    wide = _by_mark(fish.where(applied | returned).withColumn("_mark", mark), "_mark", "site")
    settled = reallocate_unknown(
        wide, "top", "bottom", "none", "iso_week", start_week, inclusive, only=F.col("site") == DOWNSTREAM
    )
    return _long(settled)


def unreadable_marks(fish: DataFrame, start_week: int = FIRST_MARK_WEEK, inclusive: bool = True) -> DataFrame:
    """Recaptured animals whose mark stays unknown."""
    rows = daily_recovered_wide(fish, start_week, inclusive)
    return rows.agg(F.coalesce(F.sum("none"), F.lit(0.0)).alias("unreadable"))


def _from_week(fish: DataFrame, first_week: int | None) -> DataFrame:
    return fish if first_week is None else fish.where(F.col("iso_week") >= first_week)


def daily_marks(
    fish: DataFrame, start_week: int = FIRST_MARK_WEEK, inclusive: bool = True, site: str = "site",
    first_week: int | None = None, keys: Sequence[str] = ("iso_year",), upstream: str = UPSTREAM, downstream: str = DOWNSTREAM,
) -> DataFrame:
    """Everything the weekly tables need, per day, from one pass over the observations.

    ``first_week`` leaves out the weeks before it; ``keys`` may name more than the year (stocks, site pairs).

    ``a_*``: marks applied upstream; ``r_*``: marks recovered downstream, unreadable ones
    reallocated; ``unmarked``: unmarked catch downstream; ``n_*``: rows behind each of them.
    """
    applied = (F.col(site) == upstream) & in_set("tag_status", ["A"])
    below = F.col("site") == downstream
    returned = below & in_set("tag_status", ["R"])
    measures = [sum_where(applied & in_set("a_caudalclip", [m]), "count").alias(f"a_{m}") for m in MARKS]
    measures += [sum_where(returned & in_set("r_caudalclip", [m]), "count").alias(f"r_{m}") for m in MARKS]
    more = [k for k in keys if k not in DAY]
    daily = _from_week(fish, first_week).groupBy(*more, *DAY).agg(
        *measures,
        sum_where(below & F.col("r_adclip").isNull(), "count").alias("unmarked"),
        F.count_if(applied).alias("n_applied"),
        F.count_if(returned).alias("n_returned"),
        F.count_if(below).alias("n_below"),
    )
    return reallocate_unknown(daily, "r_top", "r_bottom", "r_none", "iso_week", start_week, inclusive)


def weekly_release_recapture(
    fish: DataFrame, start_week: int = FIRST_MARK_WEEK, inclusive: bool = True, first_week: int | None = FIRST_MARK_WEEK
) -> DataFrame:
    """Marks applied per week beside marks recovered in the same week (NULL when none came back)."""
    sums = [F.sum(c).alias(c) for c in ("a_top", "a_bottom", "r_top", "r_bottom", "n_applied", "n_returned")]
    weekly = daily_marks(fish, start_week, inclusive, first_week=first_week).groupBy("iso_year", "iso_week").agg(*sums)
    came_back = F.col("n_returned") > 0
    return weekly.where(F.col("n_applied") > 0).select(
        "iso_year", "iso_week", "a_top", "a_bottom",
        *[F.when(came_back, F.col(c)).alias(c) for c in ("r_top", "r_bottom")],
    )


def weekly_release_columns(fish: DataFrame, weeks: Sequence[int]) -> DataFrame:
    """Marks applied with one column per release week."""
    rows = fish.where((F.col("site") == UPSTREAM) & in_set("tag_status", ["A"]) & F.col("iso_week").isin(list(weeks)))
    return to_wide(
        rows, ["iso_year"], "iso_week", weeks, F.coalesce(F.sum("count"), F.lit(0.0)), 0.0, other=None
    ).withColumnsRenamed({str(w): f"week_{w}" for w in weeks})


def weekly_unmarked(fish: DataFrame, first_week: int | None = None, downstream: str = DOWNSTREAM) -> DataFrame:
    """Animals without an earlier mark at the downstream site."""
    rows = _from_week(fish, first_week).where(F.col("site") == downstream)
    return rows.groupBy("iso_year", "iso_week", "week").agg(
        sum_where(F.col("r_adclip").isNull(), "count").alias("n")
    )


def mark_matrix(
    fish: DataFrame, start_week: int = FIRST_MARK_WEEK, inclusive: bool = True, site: str = "site",
    first_week: int | None = None, keys: Sequence[str] = ("iso_year",), upstream: str = UPSTREAM, downstream: str = DOWNSTREAM,
) -> DataFrame:
    """Release week by recovery week per season (and any further ``keys``), from the observations.

    Weeks before ``first_week``, in which batch marks did not alternate yet, are no part of the season.

    One pass reduces the observations to weekly totals (a few hundred rows per season and site
    pair), which are written once; the matrix is then built from those rows.
    """
    weekly = materialise(
        daily_marks(fish, start_week, inclusive, site, first_week, keys, upstream, downstream)
        .groupBy(*keys, week_start("date").alias("week"))
        .agg(*[F.sum(c).alias(c) for c in ("a_top", "a_bottom", "r_top", "r_bottom", "unmarked", "n_below")])
    )

    def by_mark(prefix: str) -> DataFrame:
        named = weekly.select(*keys, "week", *[F.col(f"{prefix}_{m}").alias(m) for m in BATCH_MARKS])
        return to_long(named, [*keys, "week"], BATCH_MARKS, "mark", "n")

    unmarked = weekly.where(F.col("n_below") > 0).select(*keys, "week", F.col("unmarked").alias("n"))
    return release_recovery_matrix(by_mark("a"), by_mark("r"), unmarked, keys)


def marked_against_recaptured(fish: DataFrame, species: str = "co-w", date: str = "overlay_date") -> DataFrame:
    """Daily newly marked and recaptured animals, long; a status without animals that day is NULL."""
    keys = [date, "site"]
    groups = {
        "total_marked": in_set("species", [species]) & in_set("a_adclip", ["yes"]),
        "total_recaps": in_set("r_adclip", ["yes"]),
    }
    measures = [strict_sum_where(g, "count").alias(name) for name, g in groups.items()]
    measures += [F.count_if(g).alias(f"_{name}") for name, g in groups.items()]
    daily = fish.groupBy(*keys).agg(*measures).where((F.col("_total_marked") > 0) | (F.col("_total_recaps") > 0))
    seen = daily.select(*keys, *[F.when(F.col(f"_{n}") > 0, F.col(n)).alias(n) for n in groups])
    return to_long(seen, keys, list(groups), "status", "n")
