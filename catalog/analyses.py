"""The remaining named analyses: environment, adult fence, report tables, data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.tables import REPEAT_RULES, Tables
from tallyweir.plans import environment, fence, report
from tallyweir.sources.writers import present

# ---- environment ------------------------------------------------------------------------


@query("P01 FLT-02 AGG-01", "SELECT date, coalesce(sum(count), 0) AS total FROM sv_fish WHERE species <> 'co-f' GROUP BY 1")
def daily_catch(t: Tables) -> DataFrame:
    return environment.daily_catch(t.fish)


@query(
    "P02 AGG-09",
    """SELECT date, site, round(avg(water_level_m), 8) AS mean_level, round(avg(water_temp_c), 8) AS mean_temp FROM sv_trap GROUP BY 1, 2""",
)
def daily_level_and_temperature(t: Tables) -> DataFrame:
    return rounded(environment.daily_environment(t.trap), 8)


@query(
    "P03 DOM-30",
    """SELECT station_number, CAST(ts AS DATE) AS date, parameter, round(avg(value), 10) AS value,
         CAST(year(CAST(ts AS DATE)) AS INT) AS year, CAST(dayofyear(CAST(ts AS DATE)) AS INT) AS year_day FROM sv_units GROUP BY 1, 2, 3, 5, 6""",
)
def unit_values_to_daily_means(t: Tables) -> DataFrame:
    return rounded(environment.unit_values_to_daily(t.units), 10)


@query(
    "P04 JOI-10 FLT-07 SRC-07",
    """WITH a AS (SELECT date, coalesce(sum(count), 0) AS total FROM sv_fish WHERE species <> 'co-f' AND date BETWEEN DATE '1997-05-01' AND DATE '1998-06-30' GROUP BY 1),
       b AS (SELECT date, value * 1000 AS discharge FROM sv_hydro WHERE station_number = '3-MEDIUM' AND parameter = 'Flow'
         AND date BETWEEN DATE '1997-05-01' AND DATE '1998-06-30')
       SELECT date, total, round(discharge, 6) AS discharge FROM a FULL JOIN b USING (date)""",
)
def catch_and_discharge(t: Tables) -> DataFrame:
    return rounded(environment.catch_and_discharge(t.fish, t.hydro, "3-MEDIUM", "1997-05-01", "1998-06-30"))


@query(
    "P04 JOI-10",
    """WITH moved AS (SELECT station_number, parameter, CAST(date + 9700 AS DATE) AS date, value FROM sv_hydro),
       a AS (SELECT date, avg(water_level_m) + 0.4 AS site_level FROM sv_trap WHERE site = 'fence' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1),
       b AS (SELECT date, value AS station_level FROM moved WHERE station_number = '1-URGENT' AND parameter = 'Level' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')
       SELECT date, round(site_level, 8) AS site_level, round(station_level, 10) AS station_level FROM a FULL JOIN b USING (date)""",
)
def site_level_against_station(t: Tables) -> DataFrame:
    """The stand-in gauge series is shifted into the months of the trap visits."""
    moved = t.hydro.withColumn("date", F.date_add("date", 9700))
    out = environment.level_comparison(t.trap, moved, "1-URGENT", "fence", "2024-01-05", "2024-01-25")
    return out.withColumns({"site_level": F.round("site_level", 8), "station_level": F.round("station_level", 10)})


@query(
    "FLT-07 SCL-06 SCL-11",
    """SELECT date, site, type, date + (arrival_time_24h - date_trunc('day', arrival_time_24h)) AS date_time, water_temp_c FROM sv_trap
       WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""",
)
def temperature_readings(t: Tables) -> DataFrame:
    return environment.temperature_readings(t.trap, "2024-01-05", "2024-01-25")


# ---- adult fence ------------------------------------------------------------------------


@query(
    "P06 DOM-24 SCL-09 PRJ-04",
    """SELECT year, round(coalesce(sum(date_diff('second', arrival_time, departure_time) / 3600.0), 0), 6) AS hours FROM sv_visits GROUP BY 1""",
)
def hours_worked_by_year(t: Tables) -> DataFrame:
    return rounded(fence.effort_hours(t.visits))


_PREPARED = """p AS (SELECT *, CASE WHEN mark_gender IN ('af', 'wf') THEN 'F' WHEN mark_gender IN ('am', 'wm', 'wj', 'aj') THEN 'M' ELSE mark_gender END AS gender,
  CASE WHEN mark_gender IN ('af', 'am', 'aj') THEN 'a' WHEN mark_gender IN ('wf', 'wm', 'wj') THEN 'w' ELSE mark_gender END AS mark FROM sv_adult)"""


@query(
    "P07 P12 AGG-01 AGG-05",
    "SELECT year, coalesce(sum(total), 0) AS sum_total, count(*) AS n_rows FROM sv_adult WHERE species = 'co' GROUP BY 1",
)
def adult_totals_by_year(t: Tables) -> DataFrame:
    return fence.totals(fence.prepared(t.adult))


@query(
    "P07 PRJ-05 AGG-01",
    f"WITH {_PREPARED} SELECT year, gender, coalesce(sum(total), 0) AS sum_total, count(*) AS n_rows FROM p WHERE species = 'co' GROUP BY 1, 2",
)
def adult_totals_by_year_and_sex(t: Tables) -> DataFrame:
    return fence.totals(fence.prepared(t.adult), by=("year", "gender"))


@query(
    "P08 FLT-08",
    """SELECT year, date, time_of_day, total, species, mark_gender, recap_tag_colour FROM sv_adult
       WHERE NOT coalesce((recap_tag_colour = 'orange' AND year IN (1996, 1998)) OR (recap_tag_colour = 'pink' AND year = 1997), FALSE)""",
)
def animals_counted_once(t: Tables) -> DataFrame:
    out = fence.without_repeats(t.adult, REPEAT_RULES)
    return out.select("year", "date", "time_of_day", "total", "species", "mark_gender", "recap_tag_colour")


@query(
    "P09 JOI-05 PRJ-06 AGG-01 AGG-02 SCL-07",
    f"""WITH {_PREPARED}, kept AS (SELECT * FROM p
      WHERE NOT coalesce((recap_tag_colour = 'orange' AND year IN (1996, 1998)) OR (recap_tag_colour = 'pink' AND year = 1997), FALSE)),
    j AS (SELECT year, date, CASE WHEN species = 'co' THEN total ELSE 0 END AS co, CASE WHEN mark = 'w' THEN total ELSE 0 END AS w,
        CASE WHEN mark = 'a' THEN total ELSE 0 END AS a, CASE WHEN broodstock THEN total ELSE 0 END AS b
      FROM kept FULL JOIN (SELECT year, date, time_of_day FROM sv_visits) USING (year, date, time_of_day))
    SELECT year, date, coalesce(sum(co), 0) AS total, CASE WHEN count(w) = count(*) THEN sum(w) END AS wild,
      CASE WHEN count(b) = count(*) THEN sum(b) END AS broodstock, CASE WHEN count(a) = count(*) THEN sum(a) END AS marked,
      CAST(dayofyear(date) AS INT) AS year_day, CAST(DATE '2024-01-01' + CAST(dayofyear(date) - 1 AS INT) AS DATE) AS overlay_date
    FROM j GROUP BY 1, 2""",
)
def daily_adult_series(t: Tables) -> DataFrame:
    return fence.daily_series(t.adult, t.visits, rules=REPEAT_RULES)


@query(
    "P10 DOM-24 AGG-07 AGG-14 JOI-05",
    """WITH e AS (SELECT *, row_number() OVER () AS effort_id FROM sv_visits),
       j AS (SELECT year, date, effort_id FROM e FULL JOIN sv_adult USING (year, date, time_of_day) WHERE year BETWEEN 1996 AND 2000)
       SELECT year, min(date) AS start_date, max(date) AS finish_date, count(DISTINCT date) AS days_total,
         count(DISTINCT effort_id) + CAST(max(CASE WHEN effort_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS checks_total,
         (count(DISTINCT effort_id) + max(CASE WHEN effort_id IS NULL THEN 1 ELSE 0 END)) * 1.5::DOUBLE AS hours_at_1_5,
         (count(DISTINCT effort_id) + max(CASE WHEN effort_id IS NULL THEN 1 ELSE 0 END)) * 2.0::DOUBLE AS hours_at_2 FROM j GROUP BY 1""",
)
def season_effort(t: Tables) -> DataFrame:
    return fence.season_effort(t.adult, t.visits, range(1996, 2001))


_DAILY = """d AS (SELECT year, date, count(*) AS n FROM sv_visits FULL JOIN sv_adult USING (year, date, time_of_day) WHERE species = 'co' GROUP BY 1, 2)"""


@query(
    "P11 DOM-25 FLT-06 AGG-22",
    f"""WITH {_DAILY} SELECT year, 5.0::DOUBLE AS threshold, count(*) AS days FROM d WHERE n >= 5 GROUP BY 1
      UNION ALL SELECT year, 20.0, count(*) FROM d WHERE n >= 20 GROUP BY 1""",
)
def days_over_thresholds(t: Tables) -> DataFrame:
    return fence.busy_days(t.adult, t.visits, (5, 20))


@query(
    "P14 DOM-26 WIN-05 SCL-10 AGG-16",
    f"""WITH {_DAILY}, s AS (SELECT year, 20.0::DOUBLE AS cap, CAST(NULL AS INT) AS last_day, sum(n)::DOUBLE AS total, sum(least(n, 20))::DOUBLE AS tagged FROM d GROUP BY 1
      UNION ALL SELECT year, 20.0, 288, sum(n), sum(least(n, 20)) FROM d WHERE dayofyear(date) <= 288 GROUP BY 1
      UNION ALL SELECT year, 10.0, 288, sum(n), sum(least(n, 10)) FROM d WHERE dayofyear(date) <= 288 GROUP BY 1)
    SELECT *, round(tagged / total * 100, 8) AS percent_tagged FROM s""",
)
def tagging_cap_scenarios(t: Tables) -> DataFrame:
    return rounded(fence.tagging_caps(t.adult, t.visits), 8)


@query(
    "P13 MOD-05 SCL-07",
    """SELECT year, CAST(DATE '2024-01-01' + CAST(dayofyear(date) - 1 AS INT) AS DATE) - DATE '1970-01-01' + 0.0::DOUBLE AS bin, count(*) AS n
       FROM sv_adult WHERE species = 'co' GROUP BY 1, 2""",
)
def run_timing_by_day(t: Tables) -> DataFrame:
    return fence.run_timing(t.adult)


@query(
    "P13 MOD-06",
    """WITH o AS (SELECT year, (CAST(DATE '2024-01-01' + CAST(dayofyear(date) - 1 AS INT) AS DATE) - DATE '1970-01-01')::DOUBLE AS x FROM sv_adult WHERE species = 'co'),
       r AS (SELECT (max(x) - min(x)) / 29.0::DOUBLE AS w FROM o)
       SELECT year, CAST(ceil(x / w - 0.5::DOUBLE) AS BIGINT) AS bin_no, count(*) AS n, round(ceil(x / w - 0.5::DOUBLE) * w, 6) AS bin FROM o, r GROUP BY 1, 2, 4""",
)
def run_timing_in_thirty_bins(t: Tables) -> DataFrame:
    return rounded(fence.run_timing(t.adult, width=None))


@query(
    "P15 JOI-01 SCL-18 SRC-05",
    """SELECT year, date, scale_book, fork_length_mm, CAST(floor(fork_length_mm / 50) * 50 AS DOUBLE) AS length_bin,
         CASE WHEN scale_book IN (3, 5, 8) THEN 'x' END AS no_good FROM sv_adult WHERE scale_book IS NOT NULL""",
)
def scale_subsample(t: Tables) -> DataFrame:
    out = fence.scale_subsample(t.adult, (3, 5, 8))
    return out.select("year", "date", "scale_book", "fork_length_mm", "length_bin", "no_good")


@query(
    "P15 MOD-06",
    """SELECT CAST(floor(fork_length_mm / 50) * 50 AS DOUBLE) AS length_bin, CASE WHEN scale_book IN (3, 5, 8) THEN 'x' END AS no_good, count(*) AS n
       FROM sv_adult WHERE scale_book IS NOT NULL GROUP BY 1, 2""",
)
def scale_bins(t: Tables) -> DataFrame:
    return fence.scale_bins(fence.scale_subsample(t.adult, (3, 5, 8)))


_SCALE_LENGTHS = """WITH o AS (SELECT *, CASE WHEN scale_book IN (3, 5, 8) THEN 'x' END AS no_good FROM sv_adult
    WHERE scale_book IS NOT NULL AND fork_length_mm IS NOT NULL),
  r AS (SELECT (max(fork_length_mm) - min(fork_length_mm)) / 29.0::DOUBLE AS w FROM o)
  SELECT {keys}, CAST(ceil(fork_length_mm / w - 0.5::DOUBLE) AS BIGINT) AS bin_no, count(*) AS n,
    round(ceil(fork_length_mm / w - 0.5::DOUBLE) * w, 6) AS bin FROM o, r GROUP BY ALL"""


@query("P15 MOD-06", _SCALE_LENGTHS.format(keys="broodstock"))
def scale_lengths_by_broodstock(t: Tables) -> DataFrame:
    return rounded(fence.scale_lengths(fence.scale_subsample(t.adult, (3, 5, 8)), ["broodstock"]))


@query("P15 MOD-06", _SCALE_LENGTHS.format(keys="scale_book, no_good"))
def scale_lengths_by_book(t: Tables) -> DataFrame:
    return rounded(fence.scale_lengths(fence.scale_subsample(t.adult, (3, 5, 8)), ["scale_book", "no_good"]))


# ---- report tables ----------------------------------------------------------------------

_NAMED = """named AS (SELECT * REPLACE (CASE species WHEN 'co-w' THEN 'Coho (wild)' WHEN 'co-a' THEN 'Coho (hatchery)'
    WHEN 'st/rb' THEN 'Steelhead or Rainbow trout' WHEN 'ct' THEN 'Cutthroat' WHEN 'ch' THEN 'Chinook' ELSE species END AS species,
    lower(coalesce(mort, 'no')) AS mort, lower(coalesce(sacrifice, 'no')) AS sacrifice) FROM sv_fish)"""


@query(
    "P46 SRT-03 AGG-01",
    f"WITH {_NAMED} SELECT species, coalesce(sum(count), 0) AS total FROM named WHERE species <> 'co-f' GROUP BY 1",
)
def species_totals(t: Tables) -> DataFrame:
    return report.species_totals(t.fish)


@query(
    "P38 PRJ-05 RSH-02 SRT-02",
    """WITH named AS (SELECT CASE species WHEN 'co-w' THEN 'Coho (wild)' WHEN 'co-w.r' THEN 'Coho (wild) recap' WHEN 'co-h' THEN 'Coho (hatchery)'
         WHEN 'st/rb' THEN 'Steelhead or Rainbow trout' WHEN 'ct' THEN 'Cutthroat' WHEN 'ch' THEN 'Chinook' ELSE species END AS species, site, count FROM sv_mixed)
       SELECT species, coalesce(sum(count) FILTER (WHERE site = 'barn'), 0) AS barn, coalesce(sum(count) FILTER (WHERE site = 'fence'), 0) AS fence,
         coalesce(sum(count) FILTER (WHERE coalesce(site, '') NOT IN ('barn', 'fence')), 0) AS other
       FROM named GROUP BY 1""",
)
def species_by_site(t: Tables) -> DataFrame:
    return report.species_by_site(t.mixed)


@query(
    "P47 FLT-09",
    "SELECT date, site, coalesce(sum(count), 0) AS n FROM sv_fish WHERE species = 'co-w' AND site IN ('barn', 'fence') GROUP BY 1, 2",
)
def daily_counts_by_site(t: Tables) -> DataFrame:
    return report.daily_by_site(t.fish)


@query(
    "P48 SRT-03",
    "SELECT size_cwt, coalesce(sum(count), 0) AS total FROM sv_fish WHERE species = 'co-w' AND size_cwt IS NOT NULL GROUP BY 1",
)
def size_class_totals(t: Tables) -> DataFrame:
    return report.size_class_totals(t.fish)


_MORTALITY = f"""WITH {_NAMED}, s AS (SELECT species, coalesce(sum(count), 0) AS total, coalesce(sum(count) FILTER (WHERE mort = 'yes'), 0) AS accidental,
    coalesce(sum(count) FILTER (WHERE sacrifice = 'yes'), 0) AS sacrificed FROM named WHERE species <> 'co-f' GROUP BY 1),
  m AS (SELECT species, total, accidental, sacrificed,
    regexp_replace(CAST(CAST(coalesce(round_even(accidental / nullif(total, 0) * 100, 2), 0) AS DECIMAL(20, 2)) AS VARCHAR), '\\.?0+$', '') || '%' AS percent_accidental,
    regexp_replace(CAST(CAST(coalesce(round_even(sacrificed / nullif(total, 0) * 100, 2), 0) AS DECIMAL(20, 2)) AS VARCHAR), '\\.?0+$', '') || '%' AS percent_sacrificed
    FROM s WHERE accidental > 0 OR sacrificed > 0)"""
_HATCHERY = "SELECT species, total, 0, total, '0%', '100%' FROM s WHERE species = 'Coho (hatchery)'"


@query("DOM-23 P52 SET-02 SRT-04 AGG-17", f"{_MORTALITY} SELECT * FROM m UNION ALL {_HATCHERY}")
def mortality_table(t: Tables) -> DataFrame:
    return report.mortality(t.fish)


@query("DOM-23 P52", f"{_MORTALITY} SELECT * FROM m UNION ALL {_HATCHERY}".replace("FROM named WHERE species <> 'co-f'", "FROM named"))
def mortality_of_all_species(t: Tables) -> DataFrame:
    """No species left out, unnamed animals included."""
    return report.mortality(t.fish, excluded=None)


@query(
    "DOM-23 P52 SNK-02",
    f"""{_MORTALITY}, a AS (SELECT * FROM m WHERE species <> 'Coho (hatchery)' UNION ALL {_HATCHERY})
    SELECT species AS "Species", total AS "Total Fish", accidental AS "Total Accidental", sacrificed AS "Total Sacrifice",
      percent_accidental AS "% Accidental", percent_sacrificed AS "% Sacrifice" FROM a""",
)
def mortality_table_presented(t: Tables) -> DataFrame:
    """The hatchery line replaces the measured one, under display headings."""
    headings = {
        "species": "Species", "total": "Total Fish", "accidental": "Total Accidental", "sacrificed": "Total Sacrifice",
        "percent_accidental": "% Accidental", "percent_sacrificed": "% Sacrifice",
    }
    return present(report.mortality(t.fish, replace=True), headings)


@query(
    "WIN-06 P53",
    """WITH d AS (SELECT year, date, coalesce(sum(count), 0) AS n FROM sv_fish WHERE species = 'co-w' GROUP BY 1, 2),
       h AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, date) AS a, row_number() OVER (PARTITION BY year ORDER BY n, date) AS b FROM d)
       SELECT year, max(date) FILTER (WHERE a = 1) AS peak_date, max(n) FILTER (WHERE a = 1) AS peak_n,
         max(date) FILTER (WHERE b = 1) AS low_date, max(n) FILTER (WHERE b = 1) AS low_n FROM h GROUP BY 1""",
)
def peak_and_lowest_catch(t: Tables) -> DataFrame:
    return report.peak_day(t.fish, keys=("year",))


@query(
    "P39 DOM-24 SCL-06 SCL-09 SCL-11",
    """WITH x AS (SELECT date, arrival_time_24h - date_trunc('day', arrival_time_24h) AS a, departure_time_24h - date_trunc('day', departure_time_24h) AS b FROM sv_trap)
       SELECT CAST(year(date) AS INT) AS year, min(date) AS start_date, max(date) AS finish_date, count(DISTINCT date) AS days_total,
         round(coalesce(sum(date_diff('second', date + a, date + b) / 60.0), 0) / 60, 6) AS hours_total FROM x GROUP BY 1""",
)
def trap_season_summary(t: Tables) -> DataFrame:
    return rounded(report.trap_season(t.trap))


# ---- data checks ------------------------------------------------------------------------


@query("DOM-32 P40", "SELECT row_label, date, site, a_adclip, r_adclip FROM sv_fish WHERE a_adclip IS NOT NULL AND r_adclip IS NOT NULL")
def double_marked_animals(t: Tables) -> DataFrame:
    return report.double_marked(t.fish).select("row_label", "date", "site", "a_adclip", "r_adclip")


@query("DOM-32", "SELECT count(*) FILTER (WHERE a_adclip IS NOT NULL AND r_adclip IS NOT NULL) AS violations FROM sv_fish")
def double_mark_count(t: Tables) -> DataFrame:
    from tallyweir.operators.checks import violation_count

    return violation_count(t.fish, F.col("a_adclip").isNotNull() & F.col("r_adclip").isNotNull())


@query(
    "DOM-31 SCL-19 P40",
    """WITH c AS (SELECT date, site, fork_length_mm, size_cwt, CASE WHEN fork_length_mm < 70 THEN 'little' WHEN fork_length_mm BETWEEN 70 AND 85 THEN 'small'
         WHEN fork_length_mm BETWEEN 86 AND 115 THEN 'big' WHEN fork_length_mm >= 116 THEN 'bigger' END AS size_computed FROM sv_fish WHERE species = 'co-w')
       SELECT * FROM c WHERE size_cwt <> size_computed""",
)
def size_class_mismatch(t: Tables) -> DataFrame:
    return report.size_mismatch(t.fish)


@query(
    "DOM-33",
    "SELECT mark_gender, count(*) AS n FROM sv_adult WHERE mark_gender IS NULL OR mark_gender NOT IN ('af', 'wf', 'am', 'wm') GROUP BY 1",
)
def codes_without_mapping(t: Tables) -> DataFrame:
    from tallyweir.functions.missing import recode
    from tallyweir.operators.checks import unmapped

    known = {"af": "a", "wf": "w", "am": "a", "wm": "w"}
    rows = t.adult.withColumn("mark", recode("mark_gender", known, keep_unmatched=False))
    return unmapped(rows, "mark_gender", "mark")


@query(
    "P44 PRJ-02 FLT-01 PRJ-09",
    """SELECT gr_age, eu_age, age_code, address, sp, source, life_stage, start_date, label, CAST(year(start_date) AS INT) AS year,
         TRY_CAST(address AS BIGINT) AS scale_number FROM sv_ages WHERE year(start_date) IN (1995, 1998) AND life_stage = 'Juvenile'""",
)
def age_records(t: Tables) -> DataFrame:
    return report.age_records(t.ages, [1995, 1998])
