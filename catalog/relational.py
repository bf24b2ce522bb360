"""Projections, filters, sorts, appends and reshaping (PRJ, FLT, SRT, SET, RSH)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import REPEAT_RULES, Tables
from tallyweir.functions import missing
from tallyweir.operators import checks, ordering, reshape
from tallyweir.operators.joins import unmatched
from tallyweir.sources.readers import literal_table

# ---- projections ------------------------------------------------------------------------


@query("PRJ-01", "SELECT site, date, species, fork_length_mm FROM sv_fish")
def select_and_reorder(t: Tables) -> DataFrame:
    return t.fish.select("site", "date", "species", "fork_length_mm")


@query("PRJ-02", "SELECT o_orderkey AS order_id, o_custkey AS customer, o_totalprice AS price FROM orders")
def select_with_rename(t: Tables) -> DataFrame:
    names = {"o_orderkey": "order_id", "o_custkey": "customer", "o_totalprice": "price"}
    return t.raw("orders").select(*[F.col(old).alias(new) for old, new in names.items()])


@query("PRJ-03", "SELECT * EXCLUDE (inj_n, mort_n, sacrifice_n) FROM sv_log")
def drop_columns(t: Tables) -> DataFrame:
    return t.log.drop("inj_n", "mort_n", "sacrifice_n")


@query(
    "PRJ-04",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / l_quantity AS unit_price FROM lineitem),
       b AS (SELECT *, unit_price * 1.5 AS raised FROM a)
       SELECT l_orderkey, l_linenumber, unit_price, raised, raised - unit_price AS gain FROM b""",
)
def derived_in_sequence(t: Tables) -> DataFrame:
    """Each new column may use the ones before it."""
    out = (
        t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        .withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
        .withColumn("raised", F.col("unit_price") * 1.5)
        .withColumn("gain", F.col("raised") - F.col("unit_price"))
    )
    return out.drop("l_quantity", "l_extendedprice")


@query(
    "PRJ-05",
    """SELECT CASE species WHEN 'co-w' THEN 'Coho (wild)' WHEN 'co-a' THEN 'Coho (hatchery)'
         WHEN 'st/rb' THEN 'Steelhead or Rainbow trout' WHEN 'ct' THEN 'Cutthroat' WHEN 'ch' THEN 'Chinook'
         ELSE species END AS species, count(*) AS n
       FROM sv_fish GROUP BY 1""",
)
def recode_keep_unmatched(t: Tables) -> DataFrame:
    from tallyweir.plans.report import SPECIES_NAMES

    named = missing.recode("species", SPECIES_NAMES).alias("species")
    return t.fish.groupBy(named).agg(F.count(F.lit(1)).alias("n"))


@query(
    "PRJ-06",
    """SELECT fork_length_mm, size_cwt,
         CASE WHEN fork_length_mm IS NULL THEN NULL WHEN fork_length_mm < 70 THEN 'short'
           WHEN fork_length_mm > 115 THEN 'long' ELSE 'middle' END AS length_group,
         CASE WHEN size_cwt IS NULL THEN NULL WHEN size_cwt = 'big' THEN 1 ELSE 0 END AS is_big
       FROM sv_fish""",
)
def conditional_classes(t: Tables) -> DataFrame:
    """An unknown condition gives an unknown class, not the else branch."""
    length = F.col("fork_length_mm")
    group = missing.if_else(length < 70, "short", missing.if_else(length > 115, "long", "middle"))
    big = missing.if_else(F.col("size_cwt") == "big", 1, 0)
    return t.fish.select("fork_length_mm", "size_cwt", group.alias("length_group"), big.alias("is_big"))


@query(
    "PRJ-07",
    """SELECT coalesce(mort_n, 0) AS mort_n, coalesce(head_mold_size, 'NFC') AS head_mold_size, count(*) AS n
       FROM sv_log GROUP BY 1, 2""",
)
def default_for_missing(t: Tables) -> DataFrame:
    return t.log.groupBy(
        missing.default_to("mort_n", 0.0).alias("mort_n"), missing.default_to("head_mold_size", "NFC").alias("head_mold_size")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("PRJ-08", "SELECT nullif(gr_age, '') AS gr_age, count(*) AS n FROM sv_fish GROUP BY 1")
def blank_as_missing(t: Tables) -> DataFrame:
    return t.fish.groupBy(missing.blank_to_null("gr_age").alias("gr_age")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "PRJ-09",
    """SELECT label, TRY_CAST(address AS BIGINT) AS scale_number, CAST(gr_age AS DOUBLE) AS age,
         CAST(start_date AS DATE) AS start_date FROM sv_ages""",
)
def casts_with_bad_cells(t: Tables) -> DataFrame:
    return t.ages.select(
        "label", F.col("address").try_cast("bigint").alias("scale_number"), F.col("gr_age").cast("double").alias("age"),
        F.col("start_date").cast("date").alias("start_date"),
    )


@query(
    "PRJ-10 WIN-04",
    """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS effort_id, o_orderkey, CAST(o_orderdate AS DATE) AS date
       FROM orders""",
)
def row_ids(t: Tables) -> DataFrame:
    out = ordering.with_row_id(t.raw("orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "effort_id")
    return out.select("effort_id", "o_orderkey", F.col("o_orderdate").cast("date").alias("date"))


@query("PRJ-11", "SELECT 'hatchery' AS species, 0.0::DOUBLE AS accidental, sum(l_quantity) AS total FROM lineitem")
def constant_columns(t: Tables) -> DataFrame:
    out = t.raw("lineitem").agg(F.sum("l_quantity").alias("total"))
    return out.select(F.lit("hatchery").alias("species"), F.lit(0.0).alias("accidental"), "total")


# ---- filters ----------------------------------------------------------------------------


@query(
    "FLT-01",
    """SELECT size_cwt, coalesce(species IN ('co-w', 'ct'), FALSE) AS listed, count(*) AS n FROM sv_fish
       WHERE size_cwt IN ('small', 'big') OR size_cwt IS NULL GROUP BY 1, 2""",
)
def set_membership(t: Tables) -> DataFrame:
    """Membership in a set that contains the missing value, and membership that is never unknown."""
    rows = missing.keep_in(t.fish, "size_cwt", [None, "small", "big"])
    listed = missing.in_set("species", ["co-w", "ct"]).alias("listed")
    return rows.groupBy("size_cwt", listed).agg(F.count(F.lit(1)).alias("n"))


@query("FLT-02", "SELECT site, count(*) AS n FROM sv_fish WHERE species <> 'co-f' GROUP BY 1")
def not_equal_drops_missing(t: Tables) -> DataFrame:
    return t.fish.where(F.col("species") != "co-f").groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(
    "FLT-03",
    """SELECT count(*) FILTER (WHERE tag_code IS NULL) AS untagged, count(*) FILTER (WHERE r_check_date IS NOT NULL) AS checked
       FROM sv_log""",
)
def missing_and_known(t: Tables) -> DataFrame:
    return t.log.agg(
        F.count_if(F.col("tag_code").isNull()).alias("untagged"), F.count_if(F.col("r_check_date").isNotNull()).alias("checked")
    )


@query(
    "FLT-04",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity > 10 AND l_discount > 0.02 AND (l_tax > 0.05 OR l_extendedprice < 20000)
         AND l_shipdate >= DATE '1997-01-01'""",
)
def range_conditions(t: Tables) -> DataFrame:
    """Plain comparisons on stored columns, all of which reach the scan."""
    keep = (
        (F.col("l_quantity") > 10) & (F.col("l_discount") > 0.02)
        & ((F.col("l_tax") > 0.05) | (F.col("l_extendedprice") < 20000))
        & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    )
    return t.raw("lineitem").where(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "FLT-05",
    """SELECT date, count(*) AS n FROM sv_visits
       WHERE (date BETWEEN DATE '1996-05-04' AND DATE '1996-07-15' OR date BETWEEN DATE '1997-05-03' AND DATE '1997-06-25'
         OR date BETWEEN DATE '1998-05-02' AND DATE '1998-07-06') AND dayofweek(date) + 1 BETWEEN 4 AND 7
       GROUP BY 1""",
)
def date_windows(t: Tables) -> DataFrame:
    from tallyweir.functions.dates import in_windows, weekday_number

    windows = [("1996-05-04", "1996-07-15"), ("1997-05-03", "1997-06-25"), ("1998-05-02", "1998-07-06")]
    rows = t.visits.where(in_windows("date", windows) & weekday_number("date").between(4, 7))
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "FLT-06",
    """SELECT year, date, sum(coalesce(total, 0)) AS total FROM sv_adult GROUP BY 1, 2 HAVING sum(coalesce(total, 0)) >= 100""",
)
def filter_after_aggregate(t: Tables) -> DataFrame:
    daily = t.adult.groupBy("year", "date").agg(missing.sum_known("total").alias("total"))
    return daily.where(F.col("total") >= 100)


@query(
    "FLT-08",
    """SELECT year, recap_tag_colour, count(*) AS n FROM sv_adult
       WHERE NOT coalesce((recap_tag_colour = 'orange' AND year IN (1996, 1998)) OR (recap_tag_colour = 'pink' AND year = 1997), FALSE)
       GROUP BY 1, 2""",
)
def exclusion_rules(t: Tables) -> DataFrame:
    rules = literal_table(t.spark, REPEAT_RULES, "recap_tag_colour STRING, year INT")
    kept = checks.drop_matching(t.adult, rules, ["recap_tag_colour", "year"])
    return kept.groupBy("year", "recap_tag_colour").agg(F.count(F.lit(1)).alias("n"))


@query("FLT-09", "SELECT date, site, sum(count) AS n FROM sv_fish WHERE species = 'co-w' GROUP BY 1, 2")
def required_rows(t: Tables) -> DataFrame:
    rows = t.fish.where(F.col("species") == "co-w")
    checks.require_rows(rows, "no wild fish in the observations")
    return rows.groupBy("date", "site").agg(F.sum("count").alias("n"))


# ---- sorts ------------------------------------------------------------------------------


@query(
    "SRT-01 SRT-02",
    """SELECT tag_code, n, row_number() OVER (ORDER BY tag_code ASC NULLS LAST) AS up,
         row_number() OVER (ORDER BY tag_code DESC NULLS LAST) AS down
       FROM (SELECT tag_code, count(*) AS n FROM sv_log GROUP BY 1)""",
)
def missing_sorted_last(t: Tables) -> DataFrame:
    counts = t.log.groupBy("tag_code").agg(F.count(F.lit(1)).alias("n"))
    up = ordering.rank_rows(counts, [F.col("tag_code").asc_nulls_last()], "up")
    both = ordering.rank_rows(up, [F.col("tag_code").desc_nulls_last()], "down")
    return both.select("tag_code", "n", F.col("up").cast("bigint").alias("up"), F.col("down").cast("bigint").alias("down"))


@query(
    "SRT-03 SRT-04",
    """SELECT species, n, row_number() OVER (ORDER BY CASE species WHEN 'ct' THEN 1 WHEN 'co-w' THEN 2 WHEN 'ch' THEN 3 END
         NULLS LAST, species NULLS LAST) AS position
       FROM (SELECT species, count(*) AS n FROM sv_fish GROUP BY 1)""",
)
def pinned_level_order(t: Tables) -> DataFrame:
    """Listed levels first in their order, the others alphabetically, missing last."""
    counts = t.fish.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordering.rank_rows(counts, ordering.by_levels("species", ["ct", "co-w", "ch"]))
    return ranked.withColumn("position", F.col("position").cast("bigint"))


@query(
    "SRT-05",
    """SELECT o_orderpriority, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders)
       WHERE r = 1""",
)
def top_of_each_group(t: Tables) -> DataFrame:
    rows = t.raw("orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ordering.best_per_group(rows, ["o_orderpriority"], ["o_totalprice", "o_orderkey"], largest=True)


@query("SRT-06", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 6")
def head_rows(t: Tables) -> DataFrame:
    return ordering.head(t.raw("orders").select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")])


# ---- appends and reshaping --------------------------------------------------------------


@query(
    "SET-01",
    """SELECT source, date, CAST(sum(n) AS BIGINT) AS n FROM (
         SELECT 'effort' AS source, date, count(*) AS n FROM sv_visits GROUP BY 2
         UNION ALL SELECT 'catch', date, count(*) FROM sv_adult GROUP BY 2) GROUP BY 1, 2""",
)
def append_same_columns(t: Tables) -> DataFrame:
    effort = t.visits.groupBy("date").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("effort"))
    catch = t.adult.groupBy("date").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("catch"))
    return reshape.append(effort, catch)


@query(
    "SET-02",
    """SELECT date, site, CAST(NULL AS VARCHAR) AS time_of_day, sum(count) AS n FROM sv_fish GROUP BY 1, 2
       UNION ALL SELECT date, NULL, time_of_day, sum(total) FROM sv_adult GROUP BY 1, 3""",
)
def append_fill_missing(t: Tables) -> DataFrame:
    juvenile = t.fish.groupBy("date", "site").agg(F.sum("count").alias("n"))
    adult = t.adult.groupBy("date", "time_of_day").agg(F.sum("total").alias("n"))
    return reshape.append(juvenile, adult, fill_missing=True)


@query(
    "RSH-01",
    """SELECT tag_date, tag_code, 'inj' AS what, sum(inj_n) AS n FROM sv_log GROUP BY 1, 2
       UNION ALL SELECT tag_date, tag_code, 'dead', sum(mort_n) FROM sv_log GROUP BY 1, 2
       UNION ALL SELECT tag_date, tag_code, 'used', sum(sacrifice_n) FROM sv_log GROUP BY 1, 2""",
)
def wide_to_long(t: Tables) -> DataFrame:
    wide = t.log.groupBy("tag_date", "tag_code").agg(
        F.sum("inj_n").alias("inj"), F.sum("mort_n").alias("dead"), F.sum("sacrifice_n").alias("used")
    )
    return reshape.to_long(wide, ["tag_date", "tag_code"], ["inj", "dead", "used"], "what", "n")


@query(
    "RSH-02",
    """SELECT species, CASE WHEN count(*) FILTER (WHERE site = 'barn') = 0 THEN 0
           ELSE sum(count) FILTER (WHERE site = 'barn') END AS barn,
         CASE WHEN count(*) FILTER (WHERE site = 'fence') = 0 THEN 0 ELSE sum(count) FILTER (WHERE site = 'fence') END AS fence,
         0.0::DOUBLE AS hatchery,
         CASE WHEN count(*) FILTER (WHERE coalesce(site, '') NOT IN ('barn', 'fence', 'hatchery')) = 0 THEN 0
           ELSE sum(count) FILTER (WHERE coalesce(site, '') NOT IN ('barn', 'fence', 'hatchery')) END AS other
       FROM sv_fish GROUP BY 1""",
)
def long_to_wide(t: Tables) -> DataFrame:
    """One column per site; a site without rows reads zero."""
    return reshape.to_wide(t.fish, ["species"], "site", ["barn", "fence", "hatchery"], F.sum("count"))


@query(
    "RSH-03",
    "SELECT CAST(isoyear(date) AS INT) AS iso_year, "
    + ", ".join(f"coalesce(sum(count) FILTER (WHERE week(date) = {w}), 0) AS week_{w}" for w in range(19, 27))
    + " FROM sv_wild WHERE site = 'barn' AND tag_status = 'A' AND week(date) BETWEEN 19 AND 26 GROUP BY 1",
)
def one_column_per_week(t: Tables) -> DataFrame:
    from tallyweir.plans.marks import weekly_release_columns

    return weekly_release_columns(t.wild, range(19, 27))


@query(
    "JOI-08 FLT-08",
    """SELECT o_custkey, count(*) AS n FROM orders o
       WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING') GROUP BY 1""",
)
def rows_without_partner(t: Tables) -> DataFrame:
    orders = t.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    builders = t.raw("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return unmatched(orders, builders, ["o_custkey"], null_safe=False)


@query(
    "JOI-08",
    """SELECT f.row_label, f.scale_number, f.year, a.eu_age, a.age_code
       FROM sv_fish f LEFT JOIN (SELECT CAST(year(start_date) AS INT) AS year, TRY_CAST(address AS BIGINT) AS scale_number,
           eu_age, age_code FROM sv_ages WHERE life_stage = 'Juvenile' AND address <> 'bad') a
         ON f.year = a.year AND f.scale_number = a.scale_number
       WHERE a.age_code IS NULL""",
)
def join_then_missing(t: Tables) -> DataFrame:
    """Fish without a reading, or whose reading has no code: not the same as an anti join."""
    from tallyweir.plans.report import age_records, fish_without_age_code

    ages = age_records(t.ages).where(F.col("scale_number").isNotNull())
    return fish_without_age_code(t.fish.select("row_label", "scale_number", "year"), ages)
