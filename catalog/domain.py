"""Tag accounting and mark-recapture (DOM-01 to DOM-17, DOM-27 to DOM-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.tables import Tables
from tallyweir.operators import recapture, stratified
from tallyweir.plans import estimates, marks, tagging
from tallyweir.session import materialise

# The fixed rates under the codes of the stand-in log; the last two hold for a whole week.
STAND_IN_CODES = {"18-60-75": "18-2", "18-47-83": "18-5"}
OVERRIDES = tuple((STAND_IN_CODES.get(code), week, rate) for code, week, rate in tagging.RATE_OVERRIDES)

# ---- classification ---------------------------------------------------------------------


@query(
    "DOM-01 P21",
    """SELECT site, fate, tag_status, iso_year, iso_week, count(*) AS n, sum(count) AS total FROM sv_wild GROUP BY 1, 2, 3, 4, 5""",
)
def fate_and_tag_status(t: Tables) -> DataFrame:
    return t.wild.groupBy("site", "fate", "tag_status", "iso_year", "iso_week").agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")
    )


@query(
    "DOM-02 P21 PRJ-06",
    "SELECT species, site, release_site, iso_year, count(*) AS n, sum(count) AS total FROM sv_mixed GROUP BY 1, 2, 3, 4",
)
def origin_and_release_site(t: Tables) -> DataFrame:
    return t.mixed.groupBy("species", "site", "release_site", "iso_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")
    )


# ---- tags -------------------------------------------------------------------------------

_LOG = """log AS (SELECT *, CAST(week(tag_date) AS INT) AS iso_week, coalesce(mort_n, 0) AS m, coalesce(sacrifice_n, 0) AS s,
  r_retention_n / r_sample_size AS rate FROM sv_log),
weekly AS (SELECT iso_week, coalesce(avg(rate), 1) AS retention FROM log GROUP BY 1),
detailed AS (SELECT iso_week, head_mold_size, tag_code, coalesce(avg(rate), 1) AS retention,
  CASE WHEN count(r_re_tagged_n) = count(*) THEN sum(r_re_tagged_n) END AS n_retagged
  FROM log WHERE r_check_date IS NOT NULL GROUP BY 1, 2, 3),
retags AS (SELECT tag_code, sum(r_re_tagged_n) AS n_retagged FROM sv_log WHERE r_re_tagged_n > 0 GROUP BY 1)"""
_INJECTED = """injected AS (SELECT iso_week, date, site, tag_code, head_mold_size, coalesce(sum(count), 0) AS inj_n
  FROM sv_wild WHERE tag_code IS NOT NULL AND fate = 'live' GROUP BY 1, 2, 3, 4, 5)"""
_RATED = """rated AS (SELECT i.*, CASE WHEN i.iso_week IN (19, 26) THEN 1.0 WHEN i.tag_code = '18-5' AND i.iso_week = 23 THEN 1.0
    WHEN i.tag_code = '18-2' AND i.iso_week = 21 THEN 0.9835979 ELSE d.retention END AS retention, d.n_retagged
  FROM injected i LEFT JOIN detailed d ON i.iso_week = d.iso_week AND i.tag_code IS NOT DISTINCT FROM d.tag_code
    AND i.head_mold_size IS NOT DISTINCT FROM d.head_mold_size)"""


@query("DOM-03 P16 AGG-10", f"WITH {_LOG} SELECT iso_week, round(retention, 10) AS retention FROM weekly")
def weekly_retention(t: Tables) -> DataFrame:
    return rounded(tagging.weekly_retention(t.log), 10)


@query(
    "DOM-03 P16",
    f"WITH {_LOG} SELECT iso_week, head_mold_size, tag_code, round(retention, 10) AS retention, n_retagged FROM detailed",
)
def detailed_retention(t: Tables) -> DataFrame:
    return rounded(tagging.detailed_retention(t.log), 10)


@query(
    "DOM-05 P17",
    f"""WITH {_LOG} SELECT tag_code, coalesce(sum(r_sample_size), 0) AS n, coalesce(sum(r_retention_n), 0) AS n_retained,
      round(coalesce(avg(rate), 1), 10) AS retention FROM log GROUP BY 1""",
)
def retention_by_code(t: Tables) -> DataFrame:
    return rounded(tagging.retention_by_code(t.log), 10)


@query(
    "DOM-06 P18",
    f"""WITH {_LOG} SELECT tag_code, sum(inj_n - m - s) AS injected, round_even(sum((inj_n - m - s) * retention), 0) AS est_retained,
      sum(inj_n - m - s) - round_even(sum((inj_n - m - s) * retention), 0) AS est_lost
    FROM log JOIN weekly USING (iso_week) GROUP BY 1""",
)
def tag_summary_from_log(t: Tables) -> DataFrame:
    return tagging.tag_summary(t.log)


@query(
    "DOM-06 P20 JOI-03 AGG-16",
    f"""WITH {_LOG}, s AS (SELECT tag_code, head_mold_size, sum(inj_n - m - s) AS injected,
        round_even(sum((inj_n - m - s) * retention), 0) AS est_retained FROM log JOIN weekly USING (iso_week) GROUP BY 1, 2)
    SELECT tag_code, s.head_mold_size, injected, est_retained, injected - est_retained AS est_lost,
      round_even(est_retained / injected, 2) * 100 AS percent_retention, k.length_range_mm
    FROM s LEFT JOIN (VALUES (NULL, '<70'), ('10', '70-85'), ('15', '86-115'), ('20', '116-190')) AS k(mold, length_range_mm)
      ON s.head_mold_size IS NOT DISTINCT FROM k.mold""",
)
def tag_summary_by_mold(t: Tables) -> DataFrame:
    return tagging.tag_summary_by_mold(t.log, tagging.MOLD_KEY)


@query(
    "P22 AGG-04",
    """SELECT date, site, tag_code, head_mold_size, coalesce(sum(count), 0) AS inj_n, 0.0::DOUBLE AS mort_n, 0.0::DOUBLE AS sacrifice_n
       FROM sv_wild WHERE tag_code IS NOT NULL AND fate = 'live' GROUP BY 1, 2, 3, 4""",
)
def daily_injections(t: Tables) -> DataFrame:
    return tagging.injections(t.wild, ["date", "site", "tag_code", "head_mold_size"])


@query(
    "P22",
    """SELECT iso_year, tag_code, coalesce(sum(count) FILTER (WHERE fate = 'live'), 0) AS inj_n,
         coalesce(sum(count) FILTER (WHERE fate = 'mort'), 0) AS mort_n,
         coalesce(sum(count) FILTER (WHERE fate = 'sacrifice'), 0) AS sacrifice_n
       FROM sv_mixed WHERE tag_code IS NOT NULL GROUP BY 1, 2""",
)
def injections_with_losses(t: Tables) -> DataFrame:
    return tagging.injections(t.mixed, ["iso_year", "tag_code"], live_only=False)


@query(
    "DOM-04 P22 JOI-02",
    f"""WITH {_LOG}, {_INJECTED}, {_RATED}
    SELECT iso_week, date, site, tag_code, head_mold_size, inj_n, round(retention, 10) AS retention, n_retagged FROM rated""",
)
def injections_with_overridden_rates(t: Tables) -> DataFrame:
    return rounded(tagging.injections_with_rates(t.wild, t.log, OVERRIDES), 10)


@query("P23 AGG-02", f"WITH {_LOG} SELECT tag_code, n_retagged FROM retags")
def retag_totals(t: Tables) -> DataFrame:
    return tagging.retags(t.log)


_NET = f"""WITH {_LOG}, {_INJECTED}, w AS (SELECT iso_week, tag_code, sum(inj_n) AS inj_n FROM injected GROUP BY 1, 2),
    s AS (SELECT tag_code, sum(inj_n) AS injected, round_even(sum(inj_n * retention), 0) AS est_retained, count(*) - count(retention) AS unknown
      FROM w LEFT JOIN weekly USING (iso_week) GROUP BY 1),
    net AS (SELECT s.tag_code, injected, CASE WHEN unknown = 0 THEN est_retained END AS est_retained,
      injected - CASE WHEN unknown = 0 THEN est_retained END AS est_lost, coalesce(r.n_retagged, 0) AS n_retagged,
      CASE WHEN unknown = 0 THEN est_retained END + coalesce(r.n_retagged, 0) AS net_releases
      FROM s LEFT JOIN retags r ON s.tag_code IS NOT DISTINCT FROM r.tag_code)"""
_SIZES = """sizes AS (SELECT tag_code, count(*) AS n_rows, count(fork_length_mm) AS n_measured, round_even(avg(fork_length_mm), 1) AS mean_length,
      round_even(stddev_samp(fork_length_mm), 1) AS sd_length, round_even(avg(weight_g), 1) AS mean_weight,
      round_even(stddev_samp(weight_g), 1) AS sd_weight FROM sv_wild GROUP BY 1)"""


@query("DOM-06 P24", f"{_NET} SELECT * FROM net")
def net_releases_by_code(t: Tables) -> DataFrame:
    return tagging.net_releases(t.wild, t.log)


@query(
    "DOM-06 P24 P23",
    f"""WITH {_LOG}, {_INJECTED}, {_RATED},
    s AS (SELECT tag_code, sum(inj_n) AS injected, CASE WHEN count(retention) = count(*) THEN round_even(sum(inj_n * retention), 0) END AS est_retained
      FROM rated GROUP BY 1),
    r AS (SELECT tag_code, CASE WHEN count(n_retagged) = count(*) THEN sum(n_retagged) END AS n_retagged FROM detailed GROUP BY 1)
    SELECT s.tag_code, injected, est_retained, injected - est_retained AS est_lost, n_retagged, est_retained + n_retagged AS net_releases
    FROM s LEFT JOIN r ON s.tag_code IS NOT DISTINCT FROM r.tag_code""",
)
def net_releases_with_unknown_retags(t: Tables) -> DataFrame:
    return tagging.net_releases_detailed(t.wild, t.log, OVERRIDES)


@query("P19 AGG-09 AGG-11", f"WITH {_SIZES} SELECT * FROM sizes")
def size_by_tag_code(t: Tables) -> DataFrame:
    return tagging.size_by_code(t.wild)


@query(
    "P25 SRT-01 SNK-02",
    f"""{_NET}, {_SIZES} SELECT tag_code AS "Tag Code", injected AS "#Inj", est_lost AS "Est.Lost", n_retagged AS "#Re-tagged",
      net_releases AS "Total Releases", mean_length AS "Mean FL(mm)", sd_length AS "SD FL(mm)", mean_weight AS "Mean Wt(g)",
      sd_weight AS "SD Wt(g)" FROM net LEFT JOIN sizes USING (tag_code)""",
)
def final_tag_table(t: Tables) -> DataFrame:
    return tagging.presented_tag_table(t.wild, t.log)


# ---- marks ------------------------------------------------------------------------------


@query(
    "DOM-17 P28 SCL-08",
    """SELECT iso_year, iso_week, strftime(week, '%b-%d') AS week_label,
         coalesce(sum(count) FILTER (WHERE tag_status = 'A'), 0) AS new_tags, coalesce(sum(count) FILTER (WHERE tag_status = 'R'), 0) AS recaps,
         coalesce(sum(count) FILTER (WHERE tag_status IS NULL), 0) AS unmarked,
         coalesce(sum(count) FILTER (WHERE fate = 'sacrifice'), 0) AS sacrifices, coalesce(sum(count) FILTER (WHERE fate = 'mort'), 0) AS morts
       FROM sv_wild GROUP BY 1, 2, 3""",
)
def weekly_mark_summary(t: Tables) -> DataFrame:
    return marks.weekly_summary(t.wild)


@query(
    "DOM-17 P28 AGG-15",
    """SELECT iso_year, iso_week, strftime(week, '%b-%d') AS week_label, site,
         coalesce(sum(count) FILTER (WHERE tag_status = 'A'), 0) AS new_tags, coalesce(sum(count) FILTER (WHERE tag_status = 'R'), 0) AS recaps,
         coalesce(sum(count) FILTER (WHERE tag_status IS NULL), 0) AS unmarked,
         coalesce(sum(count) FILTER (WHERE fate = 'sacrifice'), 0) AS sacrifices, coalesce(sum(count) FILTER (WHERE fate = 'mort'), 0) AS morts,
         coalesce(string_agg(DISTINCT a_caudalclip, ',' ORDER BY a_caudalclip), '') AS marks_applied,
         coalesce(string_agg(DISTINCT r_caudalclip, ',' ORDER BY r_caudalclip), '') AS marks_recovered
       FROM sv_wild GROUP BY 1, 2, 3, 4""",
)
def weekly_mark_summary_by_site(t: Tables) -> DataFrame:
    return marks.weekly_summary(t.wild, by_site=True)


_MCR = """t AS (SELECT {key} coalesce(sum(count) FILTER (WHERE {site} = 'barn' AND tag_status = 'A'), 0) AS marked,
    coalesce(sum(count) FILTER (WHERE {site} = 'fence'), 0) AS caught,
    coalesce(sum(count) FILTER (WHERE {site} = 'fence' AND tag_status = 'R'), 0) AS recaptured FROM {table} {group})"""
_CHAPMAN = """e AS (SELECT *, {m} * {c} / nullif({r}, 0) AS lincoln_petersen, ({m} + 1) * ({c} + 1) / ({r} + 1) - 1 AS chapman,
    ({m} + 1) * ({c} + 1) * ({m} - {r}) * ({c} - {r}) / (({r} + 1) * ({r} + 1) * ({r} + 2)) AS variance FROM t),
  s AS (SELECT *, sqrt(greatest(variance, 0)) AS std_error FROM e)"""
_ESTIMATE_COLUMNS = """round(lincoln_petersen, 4) AS lincoln_petersen, round(chapman, 4) AS chapman, round(variance, 2) AS variance,
    round(std_error, 4) AS std_error, round(std_error / nullif(chapman, 0) * 100, 6) AS cv_percent, round(std_error * 1.96, 4) AS half_width_95,
    round(chapman - std_error * 1.96, 4) AS lower_95, round(chapman + std_error * 1.96, 4) AS upper_95"""


def _rounded_estimates(df: DataFrame) -> DataFrame:
    digits = {"variance": 2, "cv_percent": 6, "trap_efficiency": 6}
    measured = ("lincoln_petersen", "chapman", "variance", "std_error", "cv_percent", "half_width_95", "lower_95", "upper_95",
                "trap_efficiency")
    return df.withColumns({c: F.round(c, digits.get(c, 4)) for c in df.columns if c in measured})


def _mcr(table: str, site: str = "site", key: str = "") -> str:
    group = f"GROUP BY {key}" if key else ""
    parts = _MCR.format(key=f"{key}," if key else "", site=site, table=table, group=group)
    return f"WITH {parts}, " + _CHAPMAN.format(m="marked", c="caught", r="recaptured")


@query(
    "AGG-03 DOM-07 DOM-08 DOM-09 DOM-10 DOM-11 MOD-09 P29",
    f"""{_mcr('sv_wild', key='iso_year')} SELECT iso_year, marked, caught, recaptured, {_ESTIMATE_COLUMNS},
      round(caught / nullif(chapman, 0) * 100, 6) AS trap_efficiency FROM s""",
)
def abundance_by_season(t: Tables) -> DataFrame:
    return _rounded_estimates(marks.pooled_abundance(t.wild, ["iso_year"]))


@query(
    "AGG-03 DOM-07 DOM-08 DOM-11 P29",
    f"""{_mcr('sv_wild')} SELECT marked, caught, recaptured, {_ESTIMATE_COLUMNS},
      round(caught / nullif(chapman, 0) * 100, 6) AS trap_efficiency FROM s""",
)
def abundance_overall(t: Tables) -> DataFrame:
    out = marks.pooled_abundance(t.wild)
    return _rounded_estimates(out)


@query(
    "DOM-02 DOM-07 P29",
    f"""{_mcr("(SELECT * FROM sv_mixed WHERE species IN ('co-w', 'co-w.r'))", 'release_site', 'iso_year')}
      SELECT iso_year, marked, caught, recaptured, {_ESTIMATE_COLUMNS}, round(caught / nullif(chapman, 0) * 100, 6) AS trap_efficiency FROM s""",
)
def abundance_with_transfers(t: Tables) -> DataFrame:
    """Animals moved upstream after the cut-over count where they were released."""
    rows = t.mixed.where(F.col("species").isin("co-w", "co-w.r"))
    return _rounded_estimates(marks.pooled_abundance(rows, ["iso_year"], "release_site"))


@query(
    "DOM-07 DOM-08 DOM-09",
    """WITH f AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN month(o_orderdate) <= 3 THEN 1 WHEN month(o_orderdate) BETWEEN 7 AND 9 THEN 2 END AS sample FROM orders),
       a AS (SELECT o_custkey, year, bool_or(sample = 1) AS s1, bool_or(sample = 2) AS s2 FROM f GROUP BY 1, 2),
       t AS (SELECT year, CAST(count(*) FILTER (WHERE s1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE s2) AS DOUBLE) AS n2,
         CAST(count(*) FILTER (WHERE s1 AND s2) AS DOUBLE) AS m2 FROM a GROUP BY 1)
       SELECT year, n1, n2, m2, round((n1 + 1) * (n2 + 1) / (m2 + 1) - 1, 4) AS chapman,
         round(sqrt((n1 + 1) * (n2 + 1) * (n1 - m2) * (n2 - m2) / ((m2 + 1) * (m2 + 1) * (m2 + 2))), 4) AS std_error FROM t""",
)
def customers_from_two_samples(t: Tables) -> DataFrame:
    """A population of known size: customers seen in the first and third quarter of each year."""
    month = F.month("o_orderdate")
    seen = t.raw("orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.max((month <= 3).cast("int")).alias("s1"), F.max(month.between(7, 9).cast("int")).alias("s2")
    )
    totals = seen.groupBy("year").agg(
        F.sum("s1").cast("double").alias("n1"), F.sum("s2").cast("double").alias("n2"),
        F.sum(F.col("s1") * F.col("s2")).cast("double").alias("m2"),
    )
    return rounded(
        totals.select(
            "year", "n1", "n2", "m2", recapture.chapman("n1", "n2", "m2").alias("chapman"),
            F.sqrt(recapture.chapman_variance("n1", "n2", "m2")).alias("std_error"),
        ),
        4,
    )


_DAY = """applied AS (SELECT iso_year, iso_week, year_day, date, site, coalesce(sum(count) FILTER (WHERE a_caudalclip = 'top'), 0) AS top,
    coalesce(sum(count) FILTER (WHERE a_caudalclip = 'bottom'), 0) AS bottom, coalesce(sum(count) FILTER (WHERE a_caudalclip = 'none'), 0) AS none
  FROM sv_wild WHERE site = 'barn' AND tag_status = 'A' GROUP BY 1, 2, 3, 4, 5),
day AS (SELECT iso_year, iso_week, year_day, date, site, coalesce(sum(count) FILTER (WHERE r_caudalclip = 'top'), 0) AS top,
    coalesce(sum(count) FILTER (WHERE r_caudalclip = 'bottom'), 0) AS bottom, coalesce(sum(count) FILTER (WHERE r_caudalclip = 'none'), 0) AS none
  FROM sv_wild WHERE site = 'fence' AND tag_status = 'R' GROUP BY 1, 2, 3, 4, 5),
part AS (SELECT *, coalesce(top / nullif(top + bottom, 0), 0) AS p FROM day),
given AS (SELECT *, CASE WHEN iso_week >= 19 THEN round_even(none * p, 0) ELSE 0 END AS gt,
    CASE WHEN iso_week >= 19 THEN round_even(none * (1 - p), 0) ELSE 0 END AS gb FROM part),
seen AS (SELECT iso_year, iso_week, year_day, date, site, top + gt AS top, bottom + gb AS bottom, none - (gt + gb) AS none FROM given)"""
_LONG = """SELECT iso_year, iso_week, year_day, date, site, mark, n FROM {t} UNPIVOT (n FOR mark IN (top, bottom, "none"))"""


@query("P30 AGG-04 RSH-01", f"WITH {_DAY} {_LONG.format(t='applied')}")
def daily_marks_applied(t: Tables) -> DataFrame:
    return marks.daily_applied(t.wild)


@query("DOM-16 P31 RSH-01", f"WITH {_DAY} {_LONG.format(t='seen')}")
def daily_marks_recovered(t: Tables) -> DataFrame:
    return marks.daily_recovered(t.wild)


@query("SET-01 P32", f"WITH {_DAY} {_LONG.format(t='applied')} UNION ALL {_LONG.format(t='seen')}")
def marks_applied_and_recovered(t: Tables) -> DataFrame:
    return marks.applied_and_recovered(t.wild)


@query("P32 DOM-16", f"WITH {_DAY} SELECT sum(none) AS unreadable FROM seen")
def unreadable_marks(t: Tables) -> DataFrame:
    return marks.unreadable_marks(t.wild)


@query(
    "P33 JOI-04",
    f"""WITH {_DAY}, a AS (SELECT iso_year, iso_week, sum(top) AS a_top, sum(bottom) AS a_bottom FROM applied WHERE iso_week >= 19 GROUP BY 1, 2),
    r AS (SELECT iso_year, iso_week, sum(top) AS r_top, sum(bottom) AS r_bottom FROM seen GROUP BY 1, 2)
    SELECT * FROM a LEFT JOIN r USING (iso_year, iso_week)""",
)
def weekly_release_and_recapture(t: Tables) -> DataFrame:
    return marks.weekly_release_recapture(t.wild)


@query(
    "P34",
    """SELECT iso_year, iso_week, week, coalesce(sum(count) FILTER (WHERE r_adclip IS NULL), 0) AS n
       FROM sv_wild WHERE site = 'fence' GROUP BY 1, 2, 3""",
)
def weekly_unmarked(t: Tables) -> DataFrame:
    return marks.weekly_unmarked(t.wild)


_MATRIX = f"""WITH {_DAY},
rel AS (SELECT iso_year, CAST(date_trunc('week', date) AS DATE) AS week, mark, sum(n) AS n
  FROM (SELECT iso_year, date, mark, n FROM applied UNPIVOT (n FOR mark IN (top, bottom))) GROUP BY 1, 2, 3),
rec AS (SELECT iso_year, CAST(date_trunc('week', date) AS DATE) AS week, mark, sum(n) AS n
  FROM (SELECT iso_year, date, mark, n FROM seen UNPIVOT (n FOR mark IN (top, bottom))) GROUP BY 1, 2, 3),
pairs AS (SELECT c.iso_year, c.week AS recover_week, r.week AS release_week, c.n * coalesce(r.n / sum(r.n) OVER g, 1) AS n,
    count(r.week) OVER g > 1 AS ambiguous
  FROM rec c LEFT JOIN rel r ON r.iso_year = c.iso_year AND r.mark = c.mark AND r.n > 0 AND c.week - r.week IN (0, 7)
  WHERE c.n > 0 WINDOW g AS (PARTITION BY c.iso_year, c.mark, c.week)),
cells AS (SELECT iso_year, release_week, recover_week, sum(n) AS n, bool_or(ambiguous) AS ambiguous,
    CASE WHEN release_week IS NULL THEN 'unassigned' ELSE 'recovered' END AS kind FROM pairs GROUP BY 1, 2, 3),
matrix AS (SELECT iso_year, release_week, recover_week, n, ambiguous, kind FROM cells
  UNION ALL SELECT a.iso_year, a.week, NULL, a.n - coalesce(b.m, 0), FALSE, 'never'
    FROM (SELECT iso_year, week, sum(n) AS n FROM rel GROUP BY 1, 2 HAVING sum(n) > 0) a
    LEFT JOIN (SELECT iso_year, release_week, sum(n) AS m FROM cells WHERE kind = 'recovered' GROUP BY 1, 2) b
      ON a.iso_year = b.iso_year AND a.week = b.release_week
  UNION ALL SELECT iso_year, NULL, week, coalesce(sum(count) FILTER (WHERE r_adclip IS NULL), 0), FALSE, 'unmarked'
    FROM sv_wild WHERE site = 'fence' GROUP BY 1, 3)"""


@query("DOM-12 RSH-04 P35", f"{_MATRIX} SELECT iso_year, release_week, recover_week, round(n, 6) AS n, ambiguous, kind FROM matrix")
def release_recovery_matrix(t: Tables) -> DataFrame:
    return rounded(marks.mark_matrix(t.wild))


def _bounded(sql: str) -> str:
    """The same over the weeks in which batch marks alternate."""
    return sql.replace("FROM sv_wild", "FROM (SELECT * FROM sv_wild WHERE iso_week >= 19)")


@query("P34", _bounded("""SELECT iso_year, iso_week, week, coalesce(sum(count) FILTER (WHERE r_adclip IS NULL), 0) AS n
    FROM sv_wild WHERE site = 'fence' GROUP BY 1, 2, 3"""))
def weekly_unmarked_of_mark_weeks(t: Tables) -> DataFrame:
    return marks.weekly_unmarked(t.wild, first_week=marks.FIRST_MARK_WEEK)


@query(
    "DOM-12 P35",
    _bounded(f"{_MATRIX} SELECT iso_year, release_week, recover_week, round(n, 6) AS n, ambiguous, kind FROM matrix"),
)
def release_recovery_matrix_of_mark_weeks(t: Tables) -> DataFrame:
    return rounded(marks.mark_matrix(t.wild, first_week=marks.FIRST_MARK_WEEK))


_POOLS = f"""{_MATRIX},
strata AS (SELECT iso_year, release_week AS stratum, sum(n) AS released, coalesce(sum(n) FILTER (WHERE kind = 'recovered'), 0) AS recaps
  FROM matrix WHERE kind IN ('recovered', 'never') GROUP BY 1, 2),
sums AS (SELECT *, sum(released) OVER f >= 100 AND sum(recaps) OVER f >= 10 AS top, sum(released) OVER b >= 100 AND sum(recaps) OVER b >= 10 AS tail,
    released >= 100 AND recaps >= 10 AS alone FROM strata
  WINDOW f AS (PARTITION BY iso_year ORDER BY stratum ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY iso_year ORDER BY stratum DESC ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT iso_year, coalesce(min(stratum) FILTER (WHERE top), max(stratum)) AS head_end,
    coalesce(max(stratum) FILTER (WHERE tail), min(stratum)) AS tail_start FROM sums GROUP BY 1),
opened AS (SELECT s.*, sum(CASE WHEN stratum > head_end AND stratum <= tail_start AND (alone OR stratum = tail_start) THEN 1 ELSE 0 END)
    OVER (PARTITION BY s.iso_year ORDER BY stratum ROWS UNBOUNDED PRECEDING) AS no FROM sums s JOIN ends USING (iso_year)),
pools AS (SELECT iso_year, stratum, released, recaps, min(stratum) OVER (PARTITION BY iso_year, no) AS pool FROM opened)"""


@query(
    "DOM-13 P36",
    f"{_POOLS} SELECT iso_year, stratum, round(released, 6) AS released, round(recaps, 6) AS recaps, pool FROM pools",
)
def automatic_pools(t: Tables) -> DataFrame:
    matrix = marks.mark_matrix(t.wild)
    keys = ["iso_year"]
    return rounded(recapture.auto_pool(recapture.stratum_totals(matrix, keys), estimates.POOL_MINIMUM, keys))


@query(
    "DOM-13",
    f"""{_POOLS} SELECT m.iso_year, coalesce(p.pool, m.release_week) AS release_week, m.recover_week, m.kind, round(sum(m.n), 6) AS n,
      bool_or(m.ambiguous) AS ambiguous
    FROM matrix m LEFT JOIN pools p ON m.iso_year = p.iso_year AND m.release_week = p.stratum GROUP BY 1, 2, 3, 4""",
)
def pooled_matrix(t: Tables) -> DataFrame:
    """Rows pooled physically by the automatic rule."""
    keys = ["iso_year"]
    matrix = materialise(marks.mark_matrix(t.wild))
    pools = recapture.auto_pool(recapture.stratum_totals(matrix, keys), estimates.POOL_MINIMUM, keys)
    return rounded(recapture.pool_matrix(matrix, pools.select("iso_year", "stratum", "pool"), keys=keys))


def _shared_pools(strata: str, shares: dict[str, float], suffix: str) -> str:
    """CTEs that pool strata (iso_year, stratum, measures) by shares of the season's totals."""

    def enough(window: str) -> str:
        return " AND ".join(f"sum({m}) OVER {window} >= sum({m}) OVER t * {s}::DOUBLE" for m, s in shares.items())

    alone = " AND ".join(f"{m} >= sum({m}) OVER t * {s}::DOUBLE" for m, s in shares.items())
    return f"""strata{suffix} AS ({strata}),
sums{suffix} AS (SELECT *, {enough('f')} AS top, {enough('b')} AS tail, {alone} AS alone FROM strata{suffix}
  WINDOW f AS (PARTITION BY iso_year ORDER BY stratum ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY iso_year),
    b AS (PARTITION BY iso_year ORDER BY stratum DESC ROWS UNBOUNDED PRECEDING)),
ends{suffix} AS (SELECT iso_year, coalesce(min(stratum) FILTER (WHERE top), max(stratum)) AS head_end,
    coalesce(max(stratum) FILTER (WHERE tail), min(stratum)) AS tail_start FROM sums{suffix} GROUP BY 1),
opened{suffix} AS (SELECT s.*, sum(CASE WHEN stratum > head_end AND stratum <= tail_start AND (alone OR stratum = tail_start) THEN 1 ELSE 0 END)
    OVER (PARTITION BY s.iso_year ORDER BY stratum ROWS UNBOUNDED PRECEDING) AS no FROM sums{suffix} s JOIN ends{suffix} USING (iso_year)),
pools{suffix} AS (SELECT iso_year, stratum, min(stratum) OVER (PARTITION BY iso_year, no) AS pool FROM opened{suffix})"""


_ROW_STRATA = """SELECT iso_year, release_week AS stratum, sum(n) AS released, coalesce(sum(n) FILTER (WHERE kind = 'recovered'), 0) AS recaps
  FROM matrix WHERE kind IN ('recovered', 'never') GROUP BY 1, 2"""
_COLUMN_STRATA = "SELECT iso_year, recover_week AS stratum, sum(n) AS inspected FROM matrix WHERE kind IN ('recovered', 'unmarked') GROUP BY 1, 2"
_SHARED = f"""{_MATRIX}, {_shared_pools(_ROW_STRATA, estimates.ROW_SHARES, '_r')}, {_shared_pools(_COLUMN_STRATA, estimates.COLUMN_SHARES, '_c')}"""


@query("DOM-13 P36", f"{_SHARED} SELECT * FROM pools_r")
def pools_by_share(t: Tables) -> DataFrame:
    strata = recapture.stratum_totals(marks.mark_matrix(t.wild), ["iso_year"])
    return estimates.pools_by_share(strata, estimates.ROW_SHARES).select("iso_year", "stratum", "pool")


@query(
    "DOM-13",
    f"""{_SHARED} SELECT m.iso_year, coalesce(r.pool, m.release_week) AS release_week, coalesce(c.pool, m.recover_week) AS recover_week, m.kind,
      round(sum(m.n), 6) AS n, bool_or(m.ambiguous) AS ambiguous
    FROM matrix m LEFT JOIN pools_r r ON m.iso_year = r.iso_year AND m.release_week = r.stratum
      LEFT JOIN pools_c c ON m.iso_year = c.iso_year AND m.recover_week = c.stratum GROUP BY 1, 2, 3, 4""",
)
def matrix_pooled_both_ways(t: Tables) -> DataFrame:
    """Rows and columns pooled physically."""
    keys = ["iso_year"]
    matrix = materialise(marks.mark_matrix(t.wild))
    rows = estimates.pools_by_share(recapture.stratum_totals(matrix, keys), estimates.ROW_SHARES)
    columns = estimates.pools_by_share(recapture.inspected_totals(matrix, keys), estimates.COLUMN_SHARES)
    names = ["iso_year", "stratum", "pool"]
    return rounded(recapture.pool_matrix(matrix, rows.select(*names), columns.select(*names), keys))


@query(
    "DOM-14 P36",
    f"""{_MATRIX} SELECT iso_year, 'one pool' AS model_id, round(sum(n) FILTER (WHERE kind IN ('recovered', 'never'))
        * sum(n) FILTER (WHERE kind IN ('recovered', 'unmarked')) / sum(n) FILTER (WHERE kind = 'recovered'), 1) AS n_hat,
      round(sum(n) FILTER (WHERE kind = 'recovered') / sum(n) FILTER (WHERE kind IN ('recovered', 'unmarked')), 6) AS capture_p
    FROM matrix GROUP BY 1""",
)
def one_pool_fit(t: Tables) -> DataFrame:
    """With a single pool the fitted model must equal the closed form."""
    cells = stratified.candidate_models(marks.mark_matrix(t.wild), {"one pool": "single"}, ["iso_year"])
    fits = stratified.fit_models(cells, ["iso_year"])
    return fits.select(
        "iso_year", "model_id", F.round("n_hat", 1).alias("n_hat"), F.round(F.col("capture_p")[0], 6).alias("capture_p")
    )


@query(
    "DOM-14 SET-03 P36",
    f"""{_POOLS}, own AS (SELECT * FROM matrix WHERE kind <> 'unassigned'),
    shape AS (SELECT iso_year, count(DISTINCT release_week) FILTER (WHERE kind IN ('recovered', 'never')) AS n_rows,
        count(DISTINCT recover_week) FILTER (WHERE kind IN ('recovered', 'unmarked')) AS weeks,
        count(DISTINCT recover_week) FILTER (WHERE kind = 'recovered') AS filled, count(*) FILTER (WHERE kind = 'recovered') AS cells FROM own GROUP BY 1),
    spot AS (SELECT u.iso_year, coalesce(max(f.w) FILTER (WHERE f.w <= u.recover_week), min(f.w)) AS w, any_value(u.n) AS n
      FROM (SELECT * FROM own WHERE kind = 'unmarked') u JOIN (SELECT DISTINCT iso_year, recover_week AS w FROM own WHERE kind = 'recovered') f
        ON u.iso_year = f.iso_year GROUP BY u.iso_year, u.recover_week),
    caught AS (SELECT iso_year, count(*) FILTER (WHERE n > 0) AS n FROM (SELECT iso_year, w, sum(n) AS n FROM spot GROUP BY 1, 2) GROUP BY 1),
    named AS (SELECT iso_year, stratum, recaps, 'Logical pooling to single row (LP)' AS model_id, 'all' AS pool FROM pools
      UNION ALL SELECT iso_year, stratum, recaps, 'Full weekly strata', CAST(stratum AS VARCHAR) FROM pools
      UNION ALL SELECT iso_year, stratum, recaps, 'Auto (logical) pooling', CAST(pool AS VARCHAR) FROM pools),
    models AS (SELECT iso_year, model_id, count(*) AS n_pools, bool_and(recaps > 0) AS usable
      FROM (SELECT iso_year, model_id, pool, sum(recaps) AS recaps FROM named GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT iso_year, model_id, CAST(n_rows AS INT) AS n_rows, CAST(CASE WHEN filled = 0 THEN weeks ELSE filled END AS INT) AS n_cols,
      CAST(n_pools AS INT) AS n_pools, CAST(CASE WHEN filled = 0 THEN 0 ELSE weeks - filled END AS INT) AS merged_weeks,
      CAST(CASE WHEN usable AND caught.n > 0 THEN cells + n_rows + n_pools END AS INT) AS np,
      CAST(CASE WHEN usable AND caught.n > 0 THEN caught.n - n_pools END AS INT) AS gof_df
    FROM models JOIN shape USING (iso_year) LEFT JOIN caught USING (iso_year)""",
)
def candidate_fit_shapes(t: Tables) -> DataFrame:
    """What each candidate fit is made of: everything about it that needs no iteration."""
    fits = estimates.candidate_fits(marks.mark_matrix(t.wild))
    return fits.select("iso_year", "model_id", "n_rows", "n_cols", "n_pools", "merged_weeks", "np", "gof_df")


# ---- yearly pooled estimates ------------------------------------------------------------


def _origin(table: str, year: str = "year") -> str:
    return f"""c AS (SELECT {year} AS year, count(*) FILTER (WHERE species = 'co-a') AS marked_caught,
      count(*) FILTER (WHERE species IN ('co-a', 'co-w')) AS total_caught, count(*) FILTER (WHERE species = 'co-w') AS wild_caught
    FROM {table} GROUP BY 1), t AS (SELECT * FROM c LEFT JOIN sv_releases USING (year))"""


_YEARLY = _CHAPMAN.format(m="cwt_released", c="total_caught", r="marked_caught")


@query(
    "DOM-28 DOM-09 DOM-10 MOD-09 AGG-06 P42",
    f"""WITH {_origin('sv_fish')}, {_YEARLY} SELECT year, marked_caught, total_caught, wild_caught, cwt_released, {_ESTIMATE_COLUMNS} FROM s""",
)
def yearly_abundance(t: Tables) -> DataFrame:
    return _rounded_estimates(estimates.yearly_abundance(t.fish, t.releases))


_REDUCED = """(SELECT f.species, CAST(year(f.date) AS INT) AS year FROM sv_fish f WHERE f.species IN ('co-f', 'co-w', 'co-a')
    AND dayofweek(f.date) + 1 BETWEEN 4 AND 7 AND (f.date BETWEEN DATE '1996-05-04' AND DATE '1996-07-15'
      OR f.date BETWEEN DATE '1997-05-03' AND DATE '1997-06-25' OR f.date BETWEEN DATE '1998-05-02' AND DATE '1998-07-06'))"""


@query(
    "DOM-27 FLT-05 JOI-09 SRC-09 P43",
    f"""WITH {_origin(_REDUCED)}, {_YEARLY} SELECT year, marked_caught, total_caught, wild_caught, cwt_released, {_ESTIMATE_COLUMNS} FROM s""",
)
def reduced_effort_abundance(t: Tables) -> DataFrame:
    from tallyweir.sources.readers import calendar

    seasons = [("1996-05-04", "1996-07-15"), ("1997-05-03", "1997-06-25"), ("1998-05-02", "1998-07-06")]
    days = calendar(t.spark, "1996-01-01", "1998-12-31")
    return _rounded_estimates(estimates.reduced_effort_abundance(t.fish, t.releases, days, seasons))


@query(
    "MOD-05 P43",
    f"""SELECT year, species, ceil((CAST(DATE '2024-01-01' + CAST(dayofyear(date) - 1 AS INT) AS DATE) - DATE '1970-01-01') / 5.0::DOUBLE - 0.5::DOUBLE) * 5 AS bin,
      count(*) AS n FROM {_REDUCED.replace("SELECT f.species,", "SELECT f.species, f.date,")} GROUP BY 1, 2, 3""",
)
def reduced_effort_histogram(t: Tables) -> DataFrame:
    from tallyweir.sources.readers import calendar

    seasons = [("1996-05-04", "1996-07-15"), ("1997-05-03", "1997-06-25"), ("1998-05-02", "1998-07-06")]
    days = calendar(t.spark, "1996-01-01", "1998-12-31")
    return estimates.reduced_effort_histogram(t.overlaid, days, seasons)


@query(
    "DOM-29 JOI-06 RSH-01 P41",
    """WITH o AS (SELECT *, CAST(DATE '2024-01-01' + CAST(dayofyear(date) - 1 AS INT) AS DATE) AS overlay_date FROM sv_fish),
       m AS (SELECT overlay_date, site, CASE WHEN count(count) = count(*) THEN sum(count) END AS total_marked FROM o WHERE species = 'co-w' AND a_adclip = 'yes' GROUP BY 1, 2),
       r AS (SELECT overlay_date, site, CASE WHEN count(count) = count(*) THEN sum(count) END AS total_recaps FROM o WHERE r_adclip = 'yes' GROUP BY 1, 2),
       b AS (SELECT * FROM r FULL JOIN m USING (overlay_date, site))
       SELECT overlay_date, site, 'total_marked' AS status, total_marked AS n FROM b
       UNION ALL SELECT overlay_date, site, 'total_recaps', total_recaps FROM b""",
)
def marked_against_recaptured(t: Tables) -> DataFrame:
    return marks.marked_against_recaptured(t.overlaid)


@query(
    "WIN-03 P45",
    """WITH d AS (SELECT year, date, coalesce(sum(count) FILTER (WHERE species = 'co-w'), 0) AS wild,
         coalesce(sum(count) FILTER (WHERE species = 'co-a'), 0) AS marked FROM sv_fish WHERE species IN ('co-w', 'co-a') GROUP BY 1, 2)
       SELECT year, date, wild, marked, round(wild / nullif(sum(wild) OVER (PARTITION BY year), 0), 10) AS share_wild,
         round(marked / nullif(sum(marked) OVER (PARTITION BY year), 0), 10) AS share_marked FROM d""",
)
def season_proportions(t: Tables) -> DataFrame:
    return rounded(estimates.season_proportions(t.fish), 10)
