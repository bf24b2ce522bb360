"""Scalar functions (SCL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.tables import Tables
from tallyweir.functions import dates, missing, numbers


@query(
    "SCL-01 SCL-02 SCL-04 SCL-05 SCL-07 SCL-08 SCL-03",
    """SELECT date, CAST(dayofyear(date) AS INT) AS year_day, CAST(week(date) AS INT) AS iso_week,
         CAST(isoyear(date) AS INT) AS iso_year, CAST((dayofyear(date) - 1) // 7 + 1 AS INT) AS block_week,
         CAST(dayofweek(date) + 1 AS INT) AS weekday, CAST(year(date) AS INT) AS year,
         CAST(DATE '2024-01-01' + CAST(dayofyear(date) - 1 AS INT) AS DATE) AS overlay_date,
         CAST(date_trunc('week', date) AS DATE) AS monday, strftime(date_trunc('week', date), '%b-%d') AS week_label,
         CAST(CAST(week(date) AS VARCHAR) || '.' || CAST(dayofyear(date) AS VARCHAR) AS DOUBLE) AS week_day_code, n
       FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def calendar_fields(t: Tables) -> DataFrame:
    d = "date"
    daily = t.raw("lineitem").groupBy(F.col("l_shipdate").cast("date").alias(d)).agg(F.count(F.lit(1)).alias("n"))
    return daily.select(
        d, dates.day_of_year(d).alias("year_day"), dates.iso_week(d).alias("iso_week"), dates.iso_year(d).alias("iso_year"),
        dates.block_week(d).alias("block_week"), dates.weekday_number(d).alias("weekday"), F.year(d).alias("year"),
        dates.overlay_date(d).alias("overlay_date"), dates.week_start(d).alias("monday"),
        dates.week_label(d).alias("week_label"), dates.week_day_code(d).alias("week_day_code"), "n",
    )


@query(
    "SCL-06",
    """SELECT text, coalesce(CAST(try_strptime(text, '%Y-%m-%d') AS DATE), CAST(try_strptime(text, '%m/%d/%Y') AS DATE)) AS date,
         count(*) AS n
       FROM (SELECT CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%m/%d/%Y')
           ELSE 'day ' || CAST(o_custkey % 9 AS VARCHAR) END AS text FROM orders) GROUP BY 1, 2""",
)
def dates_in_several_formats(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MM/dd/yyyy"))
        .otherwise(F.concat(F.lit("day "), (F.col("o_custkey") % 9).cast("string")))
    )
    rows = t.raw("orders").select(text.alias("text"))
    return rows.groupBy("text", dates.parse_date("text").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SCL-06 SCL-09 SCL-11",
    """SELECT date, site, arrival_time_24h, strftime(arrival_time_24h, '%H') AS hour_text,
         date + (arrival_time_24h - date_trunc('day', arrival_time_24h)) AS arrival,
         round(date_diff('second', arrival_time_24h, departure_time_24h) / 60.0, 6) AS minutes,
         round(date_diff('second', arrival_time_24h, departure_time_24h) / 3600.0, 6) AS hours
       FROM sv_trap""",
)
def times_and_durations(t: Tables) -> DataFrame:
    a, b = "arrival_time_24h", "departure_time_24h"
    return rounded(
        t.trap.select(
            "date", "site", a, F.substring(F.col(a).cast("string"), 12, 2).alias("hour_text"),
            dates.with_time_of_day("date", a).alias("arrival"), dates.minutes_between(a, b).alias("minutes"),
            dates.hours_between(a, b).alias("hours"),
        )
    )


@query(
    "SCL-10",
    """SELECT year, CASE WHEN dayofyear(date) <= 288 THEN 'pre' ELSE 'post' END AS part, count(*) AS n FROM sv_adult GROUP BY 1, 2""",
)
def before_or_after_cut(t: Tables) -> DataFrame:
    return t.adult.groupBy("year", dates.season_part("date", 288).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SCL-11 SCL-12 SCL-13",
    """SELECT p_partkey, lower(p_brand) || '-' || p_type AS label, substr(p_name, 1, 5) AS start_text,
         p_brand || nullif(p_type, 'PROMO') AS joined FROM part""",
)
def text_functions(t: Tables) -> DataFrame:
    return t.raw("part").select(
        "p_partkey", F.concat(F.lower("p_brand"), F.lit("-"), "p_type").alias("label"),
        F.substring("p_name", 1, 5).alias("start_text"), F.concat("p_brand", F.nullif(F.col("p_type"), F.lit("PROMO"))).alias("joined"),
    )


@query("SCL-14", "SELECT p_name, count(*) AS n FROM part WHERE regexp_matches(p_name, '^red.+t$') GROUP BY 1")
def names_by_pattern(t: Tables) -> DataFrame:
    return t.raw("part").where(F.col("p_name").rlike("^red.+t$")).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SCL-15",
    """SELECT o_orderkey, round_even(CAST(o_custkey AS DOUBLE) / 2, 0) AS half, round_even(CAST(o_custkey AS DOUBLE) / 8, 2) AS eighth
       FROM orders""",
)
def round_half_to_even(t: Tables) -> DataFrame:
    half, eighth = F.col("o_custkey").cast("double") / 2, F.col("o_custkey").cast("double") / 8
    return t.raw("orders").select(
        "o_orderkey", numbers.round_even(half).alias("half"), numbers.round_even(eighth, 2).alias("eighth")
    )


@query(
    "SCL-16",
    """SELECT l_orderkey, l_linenumber, round(log10(l_extendedprice), 8) AS log_price, round(sqrt(l_quantity), 8) AS root,
         round(pow(l_quantity, 3), 4) AS cubed FROM lineitem""",
)
def logs_roots_powers(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.log10("l_extendedprice"), 8).alias("log_price"),
        F.round(F.sqrt("l_quantity"), 8).alias("root"), F.round(F.pow("l_quantity", F.lit(3.0)), 4).alias("cubed"),
    )


@query("SCL-17", "SELECT count(*) AS n_rows, CAST(19 AS INT) AS n_columns FROM sv_fish")
def table_size(t: Tables) -> DataFrame:
    return t.fish.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(t.fish.columns)))


@query(
    "SCL-18",
    "SELECT CAST(floor(fork_length_mm / 5) * 5 AS DOUBLE) AS bin, count(*) AS n FROM sv_fish GROUP BY 1",
)
def left_closed_bins(t: Tables) -> DataFrame:
    return t.fish.groupBy(numbers.bin_floor("fork_length_mm", 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SCL-19",
    """SELECT CASE WHEN fork_length_mm < 70 THEN 'little' WHEN fork_length_mm BETWEEN 70 AND 85 THEN 'small'
         WHEN fork_length_mm BETWEEN 86 AND 115 THEN 'big' WHEN fork_length_mm >= 116 THEN 'bigger' END AS class,
         count(*) AS n, min(fork_length_mm) AS shortest, max(fork_length_mm) AS longest
       FROM sv_fish GROUP BY 1""",
)
def length_classes(t: Tables) -> DataFrame:
    """Fixed breaks with gaps: a length of 85.5 has no class."""
    out = t.fish.groupBy(numbers.length_class("fork_length_mm").alias("class"))
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.min("fork_length_mm").alias("shortest"), F.max("fork_length_mm").alias("longest")
    )


@query(
    "SCL-20",
    """WITH r AS (SELECT CAST(floor(min(fork_length_mm)) AS INT) AS a, CAST(floor(max(fork_length_mm)) AS INT) AS b FROM sv_fish)
       SELECT CAST(unnest(generate_series(a, b, 25)) AS INT) AS break FROM r""",
)
def axis_breaks(t: Tables) -> DataFrame:
    ends = t.fish.agg(
        F.floor(F.min("fork_length_mm")).cast("int").alias("a"), F.floor(F.max("fork_length_mm")).cast("int").alias("b")
    )
    return ends.select(F.explode(F.sequence("a", "b", F.lit(25))).alias("break"))


@query(
    "DOM-18",
    """SELECT row_label, weight_g / (fork_length_mm * fork_length_mm * fork_length_mm) * 100000.0 AS k FROM sv_fish""",
)
def condition_factor(t: Tables) -> DataFrame:
    return t.fish.select("row_label", numbers.condition_factor("weight_g", "fork_length_mm").alias("k"))


@query(
    "FLT-03 PRJ-07",
    """SELECT species, round(coalesce(sum(count) FILTER (WHERE site = 'barn') / nullif(sum(count), 0), 0), 6) AS share FROM sv_fish GROUP BY 1""",
)
def ratio_with_default(t: Tables) -> DataFrame:
    out = t.fish.groupBy("species").agg(
        F.sum(F.when(F.col("site") == "barn", F.col("count"))).alias("a"), F.sum("count").alias("b")
    )
    return rounded(out.select("species", missing.ratio_or("a", "b", 0.0).alias("share")))
