"""Joins (JOI)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.tables import Tables
from tallyweir.operators import joins

def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


@query(
    "JOI-01",
    """SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, o.o_totalprice FROM orders o
       LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey""",
)
def left_join_one_key(t: Tables) -> DataFrame:
    """Neither side is hinted: sizes known at run time decide between broadcast and sort-merge."""
    customers = t.raw("customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = t.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.left_join(orders, customers, ["o_custkey"], null_safe=False)


@query(
    "JOI-02",
    """WITH a AS (SELECT week(date) AS w, tag_code, head_mold_size, sum(count) AS caught FROM sv_fish GROUP BY ALL),
       b AS (SELECT week(tag_date) AS w, tag_code, head_mold_size, sum(inj_n) AS injected FROM sv_log GROUP BY ALL)
       SELECT CAST(a.w AS INT) AS iso_week, a.tag_code, a.head_mold_size, a.caught, b.injected
       FROM a LEFT JOIN b ON a.w = b.w AND a.tag_code IS NOT DISTINCT FROM b.tag_code
         AND a.head_mold_size IS NOT DISTINCT FROM b.head_mold_size""",
)
def left_join_composite_key(t: Tables) -> DataFrame:
    """Three keys, two of which may be missing on both sides."""
    caught = t.fish.groupBy(F.weekofyear("date").alias("iso_week"), "tag_code", "head_mold_size").agg(F.sum("count").alias("caught"))
    injected = t.log.groupBy(F.weekofyear("tag_date").alias("iso_week"), "tag_code", "head_mold_size").agg(
        F.sum("inj_n").alias("injected")
    )
    return joins.left_join(caught, injected, ["iso_week", "tag_code", "head_mold_size"])


@query(
    "JOI-03",
    """WITH a AS (SELECT tag_code, count(*) AS n_fish FROM sv_fish GROUP BY 1), b AS (SELECT tag_code, count(*) AS n_batches FROM sv_log GROUP BY 1)
       SELECT a.tag_code, n_fish, n_batches FROM a LEFT JOIN b ON a.tag_code IS NOT DISTINCT FROM b.tag_code""",
)
def left_join_missing_matches_missing(t: Tables) -> DataFrame:
    return joins.left_join(
        t.fish.groupBy("tag_code").agg(F.count(F.lit(1)).alias("n_fish")),
        t.log.groupBy("tag_code").agg(F.count(F.lit(1)).alias("n_batches")),
        ["tag_code"],
    )


@query(
    "JOI-04",
    """WITH a AS (SELECT year, date, count(*) AS fish FROM sv_adult GROUP BY 1, 2), b AS (SELECT year, date, count(*) AS checks FROM sv_visits GROUP BY 1, 2)
       SELECT a.year, a.date, fish, checks FROM a LEFT JOIN b USING (year, date)""",
)
def natural_left_join(t: Tables) -> DataFrame:
    """Keys are the shared columns, made explicit."""
    fish = t.adult.groupBy("year", "date").agg(F.count(F.lit(1)).alias("fish"))
    checks = t.visits.groupBy("year", "date").agg(F.count(F.lit(1)).alias("checks"))
    return joins.left_join(fish, checks, joins.natural_keys(fish, checks))


@query(
    "JOI-05",
    """SELECT year, date, count(*) AS rows, count(a.total) AS n_total, round(sum(a.total), 2) AS total, count(v.arrival_time) AS n_visits
       FROM sv_adult a FULL JOIN sv_visits v USING (year, date, time_of_day) GROUP BY 1, 2""",
)
def full_join_many_to_many(t: Tables) -> DataFrame:
    """Totals over every pairing of catch rows and checks of a visit, without forming the pairs.

    Each side is reduced to one row per visit; a total over the pairs is the product with the
    number of rows on the other side (one when the other side has none).
    """
    visit = ["year", "date", "time_of_day"]
    fish = t.adult.groupBy(*visit).agg(
        F.count(F.lit(1)).alias("_f"), F.count("total").alias("_known"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("_sum")
    )
    checks = t.visits.groupBy(*visit).agg(F.count(F.lit(1)).alias("_c"), F.count("arrival_time").alias("_a"))
    both = joins.full_join(fish, checks, visit)
    times_f, times_c = F.coalesce("_f", F.lit(1)), F.coalesce("_c", F.lit(1))
    known = F.sum(F.coalesce("_known", F.lit(0)) * times_c)
    total = F.sum(F.coalesce("_sum", F.lit(0.0)) * times_c)
    out = both.groupBy("year", "date").agg(
        F.sum(times_f * times_c).alias("rows"), known.alias("n_total"), F.when(known > 0, total).alias("total"),
        F.sum(F.coalesce("_a", F.lit(0)) * times_f).alias("n_visits"),
    )
    return rounded(out, 2)


@query(
    "JOI-06",
    """WITH a AS (SELECT date, site, sum(count) AS marked FROM sv_fish WHERE a_adclip = 'yes' GROUP BY ALL),
       b AS (SELECT date, site, sum(count) AS recaps FROM sv_fish WHERE r_adclip = 'yes' GROUP BY ALL)
       SELECT date, site, recaps, marked FROM b FULL JOIN a USING (date, site)""",
)
def natural_full_join(t: Tables) -> DataFrame:
    keys = ["date", "site"]
    marked = t.fish.where(F.col("a_adclip") == "yes").groupBy(*keys).agg(F.sum("count").alias("marked"))
    recaps = t.fish.where(F.col("r_adclip") == "yes").groupBy(*keys).agg(F.sum("count").alias("recaps"))
    return joins.full_join(recaps, marked, joins.natural_keys(recaps, marked))


@query(
    "JOI-07",
    """SELECT f.row_label, f.fork_length_mm, f.year, f.scale_number, a.eu_age, a.age_code FROM sv_fish f
       JOIN (SELECT CAST(year(start_date) AS INT) AS year, TRY_CAST(address AS BIGINT) AS scale_number, eu_age, age_code FROM sv_ages
         WHERE life_stage = 'Juvenile') a ON f.year = a.year AND f.scale_number = a.scale_number""",
)
def inner_join_shared_keys(t: Tables) -> DataFrame:
    from tallyweir.plans.report import age_records, aged_fish

    fish = t.fish.select("row_label", "fork_length_mm", "year", "scale_number")
    ages = age_records(t.ages).where(F.col("scale_number").isNotNull())
    return aged_fish(fish, ages)


@query(
    "JOI-09",
    """WITH span AS (SELECT min(date) AS a, max(date) AS b FROM sv_adult),
       days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
       c AS (SELECT date, species, count(*) AS n FROM sv_adult WHERE species = 'ch' GROUP BY 1, 2)
       SELECT days.date, coalesce(species, 'NFC') AS species, coalesce(n, 0) AS n FROM days LEFT JOIN c ON days.date = c.date""",
)
def calendar_gap_fill(t: Tables) -> DataFrame:
    span = t.adult.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    counts = t.adult.where(F.col("species") == "ch").groupBy("date", "species").agg(_n())
    filled = joins.calendar_fill(days, counts)
    return filled.select("date", F.coalesce("species", F.lit("NFC")).alias("species"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "JOI-10 SRC-07",
    """WITH a AS (SELECT date, sum(count) AS caught FROM sv_fish GROUP BY 1),
       b AS (SELECT date, value * 1000 + 0.4 AS flow FROM sv_hydro WHERE station_number = '1-URGENT' AND parameter = 'Flow')
       SELECT date, caught, round(flow, 6) AS flow FROM a FULL JOIN b USING (date)""",
)
def aligned_daily_series(t: Tables) -> DataFrame:
    caught = t.fish.groupBy("date").agg(F.sum("count").alias("caught"))
    flow = t.hydro.where((F.col("station_number") == "1-URGENT") & (F.col("parameter") == "Flow"))
    out = joins.align_series(
        caught, flow.select("date", F.col("value").alias("flow")), ["date"], scale={"flow": 1000}, shift={"flow": 0.4}
    )
    return rounded(out)
