"""Aggregates and window-shaped results (AGG, WIN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.tables import Tables
from tallyweir.functions import missing, numbers
from tallyweir.operators import aggregates, biology, ordering, scenarios

def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


@query("AGG-01", "SELECT species, site, coalesce(sum(count), 0) AS total FROM sv_fish GROUP BY 1, 2")
def sum_missing_ignored(t: Tables) -> DataFrame:
    return t.fish.groupBy("species", "site").agg(missing.sum_known("count").alias("total"))


@query(
    "AGG-02",
    """SELECT date, CASE WHEN count(count) = count(*) THEN sum(count) END AS strict_total, coalesce(sum(count), 0) AS total
       FROM sv_fish GROUP BY 1""",
)
def sum_missing_propagates(t: Tables) -> DataFrame:
    return t.fish.groupBy("date").agg(missing.sum_strict("count").alias("strict_total"), missing.sum_known("count").alias("total"))


@query(
    "AGG-03 AGG-04",
    """SELECT sum(count) FILTER (WHERE site = 'barn' AND a_adclip = 'yes') AS marked,
         sum(count) FILTER (WHERE site = 'fence') AS caught, sum(count) FILTER (WHERE site = 'nowhere') IS NULL AS none FROM sv_fish""",
)
def totals_under_conditions(t: Tables) -> DataFrame:
    barn = (F.col("site") == "barn") & (F.col("a_adclip") == "yes")
    out = t.fish.agg(
        missing.sum_where(barn, "count").alias("marked"), missing.sum_where(F.col("site") == "fence", "count").alias("caught"),
        missing.sum_where(F.col("site") == "nowhere", "count").alias("none"),
    )
    return out.withColumn("none", F.col("none") == 0)


@query(
    "AGG-04",
    """SELECT year, coalesce(sum(count) FILTER (WHERE a_caudalclip = 'top'), 0) AS top,
         coalesce(sum(count) FILTER (WHERE a_caudalclip = 'bottom'), 0) AS bottom FROM sv_fish GROUP BY 1""",
)
def conditional_sums(t: Tables) -> DataFrame:
    return t.fish.groupBy("year").agg(
        *[missing.sum_where(missing.in_set("a_caudalclip", [m]), "count").alias(m) for m in ("top", "bottom")]
    )


@query(
    "AGG-05 AGG-06",
    """SELECT year, count(*) AS n, count(*) FILTER (WHERE species = 'co-a') AS n_hatchery,
         count(*) FILTER (WHERE species IN ('co-a', 'co-w')) AS n_coho FROM sv_fish GROUP BY 1""",
)
def row_counts(t: Tables) -> DataFrame:
    return t.fish.groupBy("year").agg(
        _n(), F.count_if(F.col("species") == "co-a").alias("n_hatchery"),
        F.count_if(F.col("species").isin("co-a", "co-w")).alias("n_coho"),
    )


@query(
    "AGG-07",
    """SELECT site, count(DISTINCT tag_code) + CAST(max(CASE WHEN tag_code IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_codes,
         count(DISTINCT date) AS n_days FROM sv_fish GROUP BY 1""",
)
def distinct_counts_with_missing(t: Tables) -> DataFrame:
    return t.fish.groupBy("site").agg(
        missing.n_distinct_with_missing("tag_code").alias("n_codes"), F.count_distinct("date").alias("n_days")
    )


@query("AGG-08", "SELECT DISTINCT mark_gender FROM sv_adult")
def distinct_values(t: Tables) -> DataFrame:
    return t.adult.select("mark_gender").distinct()


@query(
    "AGG-09 AGG-11 AGG-12",
    """SELECT tag_code, count(*) AS n_rows, count(fork_length_mm) AS n_measured, round(avg(fork_length_mm), 6) AS mean_length,
         round(stddev_samp(fork_length_mm), 6) AS sd_length, min(fork_length_mm) AS shortest, max(fork_length_mm) AS longest
       FROM sv_fish GROUP BY 1""",
)
def mean_sd_range(t: Tables) -> DataFrame:
    length = "fork_length_mm"
    return rounded(
        t.fish.groupBy("tag_code").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(length).alias("n_measured"), F.avg(length).alias("mean_length"),
            F.stddev_samp(length).alias("sd_length"), F.min(length).alias("shortest"), F.max(length).alias("longest"),
        )
    )


@query(
    "AGG-10",
    """SELECT tag_date, tag_code, round(coalesce(avg(r_retention_n / r_sample_size), 1), 8) AS retention FROM sv_log GROUP BY 1, 2""",
)
def mean_with_fallback(t: Tables) -> DataFrame:
    rate = missing.ratio("r_retention_n", "r_sample_size")
    return rounded(t.log.groupBy("tag_date", "tag_code").agg(missing.mean_or(rate, 1.0).alias("retention")), 8)


@query(
    "AGG-13",
    """SELECT site, count(weight_g) AS n, round(quantile_cont(weight_g, 0.25), 8) AS q0, round(quantile_cont(weight_g, 0.5), 8) AS q1,
         round(quantile_cont(weight_g, 0.75), 8) AS q2, round(quantile_cont(weight_g, 0.99), 8) AS q3
       FROM sv_fish GROUP BY 1""",
)
def exact_quantiles_by_group(t: Tables) -> DataFrame:
    return rounded(aggregates.exact_quantiles(t.fish, "weight_g", (0.25, 0.5, 0.75, 0.99), ["site"]), 8)


@query(
    "AGG-14",
    """SELECT o_orderpriority, arg_min(o_custkey, o_orderkey) AS first_customer, arg_max(o_custkey, o_orderkey) AS last_customer
       FROM orders GROUP BY 1""",
)
def first_and_last_in_order(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy("o_orderpriority").agg(
        aggregates.first_by("o_custkey", "o_orderkey").alias("first_customer"),
        aggregates.last_by("o_custkey", "o_orderkey").alias("last_customer"),
    )


@query(
    "AGG-15",
    """SELECT date, coalesce(string_agg(DISTINCT r_caudalclip, ',' ORDER BY r_caudalclip), '') AS marks FROM sv_fish GROUP BY 1""",
)
def distinct_values_as_text(t: Tables) -> DataFrame:
    return aggregates.distinct_text_by(t.fish, ["date"], "r_caudalclip", "marks")


@query(
    "AGG-16 AGG-17",
    """WITH s AS (SELECT species, round_even(coalesce(sum(count) FILTER (WHERE mort IS NOT NULL), 0) / nullif(sum(count), 0) * 100, 2) AS p
         FROM sv_fish GROUP BY 1)
       SELECT species, p AS percent, regexp_replace(CAST(CAST(coalesce(p, 0) AS DECIMAL(20, 2)) AS VARCHAR), '\\.?0+$', '') || '%' AS text FROM s""",
)
def percentages(t: Tables) -> DataFrame:
    sums = t.fish.groupBy("species").agg(
        missing.sum_where(F.col("mort").isNotNull(), "count").alias("dead"), F.sum("count").alias("total")
    )
    percent = numbers.round_even(missing.ratio("dead", "total") * 100, 2)
    return sums.select("species", percent.alias("percent"), numbers.percent_text(percent).alias("text"))


@query("AGG-18", "SELECT CAST(year(o_orderdate) AS INT) AS year, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY 1")
def group_by_expression(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.raw("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@query(
    "AGG-19 AGG-20 AGG-21 WIN-03",
    """WITH c AS (SELECT size_cwt, gr_age, count(*) AS n FROM sv_fish WHERE size_cwt IS NOT NULL AND gr_age IS NOT NULL GROUP BY 1, 2)
       SELECT size_cwt, gr_age, n, CAST(sum(n) OVER (PARTITION BY size_cwt) AS BIGINT) AS row_total,
         round(n / sum(n) OVER (PARTITION BY size_cwt), 8) AS share FROM c""",
)
def contingency_table(t: Tables) -> DataFrame:
    return rounded(aggregates.contingency(t.fish, "size_cwt", "gr_age"), 8)


@query(
    "AGG-22",
    """WITH d AS (SELECT year, date, count(*) AS n FROM sv_adult GROUP BY 1, 2)
       SELECT year, CAST(sum(n) AS BIGINT) AS total, count(*) AS days, round(avg(n), 6) AS per_day FROM d GROUP BY 1""",
)
def two_level_totals(t: Tables) -> DataFrame:
    daily = t.adult.groupBy("year", "date").agg(_n())
    return rounded(daily.groupBy("year").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("days"), F.avg("n").alias("per_day")))


_LOG_COLUMNS = (
    ("tag_date", "date"), ("tag_code", "string"), ("head_mold_size", "string"), ("inj_n", "double"), ("mort_n", "double"),
    ("sacrifice_n", "double"), ("r_check_date", "date"), ("r_retention_n", "double"), ("r_sample_size", "double"),
    ("r_re_tagged_n", "double"),
)


@query(
    "AGG-23",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS data_type, count({c}) AS n_known, count(*) - count({c}) AS n_missing, "
        f"count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS smallest, CAST(max({c}) AS VARCHAR) AS largest FROM sv_log"
        for c, k in _LOG_COLUMNS
    ),
)
def column_profile(t: Tables) -> DataFrame:
    return aggregates.profile(t.log, exact=True)


# ---- window-shaped ----------------------------------------------------------------------


@query(
    "WIN-01",
    """SELECT o_orderkey, CAST(dayofyear(CAST(o_orderdate AS DATE)) AS INT) AS year_day,
         CAST((SELECT dayofyear(min(CAST(o_orderdate AS DATE))) FROM orders) AS INT) AS start_day FROM orders""",
)
def first_value_on_all_rows(t: Tables) -> DataFrame:
    """A one-row aggregate as a scalar subquery, instead of a window over the whole table."""
    orders = t.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    start = orders.agg(F.dayofyear(F.min("date")).alias("d")).scalar()
    return orders.select("o_orderkey", F.dayofyear("date").alias("year_day"), start.alias("start_day"))


@query(
    "WIN-02",
    """WITH s AS (SELECT year, species, sum(total) AS total FROM sv_adult GROUP BY 1, 2)
       SELECT year, species, total, total - min(total) OVER (PARTITION BY year) AS above_least FROM s""",
)
def difference_to_least(t: Tables) -> DataFrame:
    sums = t.adult.groupBy("year", "species").agg(F.sum("total").alias("total"))
    return sums.withColumn("above_least", F.col("total") - F.min("total").over(Window.partitionBy("year")))


@query(
    "WIN-03",
    """WITH d AS (SELECT year, date, sum(total) AS n FROM sv_adult GROUP BY 1, 2)
       SELECT year, date, n, round(n / sum(n) OVER (PARTITION BY year), 10) AS share FROM d""",
)
def daily_share_of_season(t: Tables) -> DataFrame:
    daily = t.adult.groupBy("year", "date").agg(F.sum("total").alias("n"))
    return rounded(aggregates.shares(daily, ["year"], "n"), 10)


@query(
    "WIN-05",
    """SELECT date, o_orderkey FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey,
         row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3""",
)
def first_rows_of_each_day(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_orderkey")
    return ordering.first_per_group_rows(rows, ["date"], [F.col("o_orderkey")], 3)


@query(
    "WIN-05 DOM-26",
    """WITH d AS (SELECT year, date, count(*) AS n FROM sv_adult GROUP BY 1, 2), s AS (
         SELECT year, 8.0::DOUBLE AS cap, CAST(NULL AS INT) AS last_day, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(least(n, 8)) AS DOUBLE) AS tagged FROM d GROUP BY 1
         UNION ALL SELECT year, 4.0, 288, sum(n), sum(least(n, 4)) FROM d WHERE dayofyear(date) <= 288 GROUP BY 1)
       SELECT year, cap, last_day, total, tagged, round(tagged / total * 100, 8) AS percent_tagged FROM s""",
)
def daily_cap(t: Tables) -> DataFrame:
    daily = t.adult.groupBy("year", "date").agg(_n())
    return rounded(scenarios.capped_tagging(daily, "n", [(8, None), (4, 288)]), 8)


@query(
    "WIN-06",
    """WITH d AS (SELECT year, date, sum(total) AS n FROM sv_adult GROUP BY 1, 2 HAVING sum(total) IS NOT NULL),
       h AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, date) AS a, row_number() OVER (PARTITION BY year ORDER BY n, date) AS b FROM d)
       SELECT year, max(date) FILTER (WHERE a = 1) AS peak_date, max(n) FILTER (WHERE a = 1) AS peak_n,
         max(date) FILTER (WHERE b = 1) AS low_date, max(n) FILTER (WHERE b = 1) AS low_n FROM h GROUP BY 1""",
)
def peak_and_lowest_day(t: Tables) -> DataFrame:
    daily = t.adult.groupBy("year", "date").agg(F.sum("total").alias("n"))
    return biology.peak_and_trough(daily, "n", ["year"])
