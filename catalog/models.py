"""Size, age and condition tables, regressions and plot statistics (DOM-18 to DOM-22, MOD)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.tables import Tables
from tallyweir.operators import histograms, regression
from tallyweir.plans import environment, report

_MEASURED = "species IN ('co-w', 'co-a') AND weight_g > 0 AND fork_length_mm > 0"
_K = """k AS (SELECT year, date, row_label, weight_g / (fork_length_mm * fork_length_mm * fork_length_mm) * 100000.0 AS k
  FROM sv_fish WHERE species = 'co-w' AND weight_g > 0 AND fork_length_mm > 0)"""


@query(
    "DOM-19 AGG-13 P51",
    f"""WITH {_K} SELECT count(*) AS n, round(avg(k), 8) AS mean, round(stddev_samp(k), 8) AS sd, round(min(k), 8) AS min,
      round(quantile_cont(k, 0.25), 8) AS q1, round(quantile_cont(k, 0.5), 8) AS median, round(quantile_cont(k, 0.75), 8) AS q3,
      round(max(k), 8) AS max FROM k""",
)
def condition_distribution(t: Tables) -> DataFrame:
    return rounded(report.condition_summary(t.fish), 8)


@query(
    "DOM-18 DOM-20 P27",
    "SELECT row_label, date, fork_length_mm, k FROM sv_wild WHERE k < 0.7",
)
def low_condition_animals(t: Tables) -> DataFrame:
    return report.low_condition(t.wild)


_AGED = """aged AS (SELECT CAST(floor(fork_length_mm / 5) * 5 AS DOUBLE) AS length_bin, TRY_CAST(nullif(gr_age, '') AS INT) AS age, fork_length_mm
  FROM sv_fish WHERE species = 'co-w'),
key AS (SELECT length_bin, age, count(*) AS n FROM aged WHERE age IN (22, 33, 44) AND length_bin IS NOT NULL GROUP BY 1, 2),
shares AS (SELECT *, CAST(sum(n) OVER (PARTITION BY length_bin) AS BIGINT) AS row_total, n / sum(n) OVER (PARTITION BY length_bin) AS share FROM key)"""


@query(
    "DOM-21 SCL-18 AGG-19 AGG-20 AGG-21 P49",
    f"WITH {_AGED} SELECT length_bin, age, n, row_total, round(share, 10) AS share FROM shares",
)
def age_length_key(t: Tables) -> DataFrame:
    return rounded(report.age_length_key(t.fish), 10)


@query(
    "DOM-22 P49",
    f"""WITH {_AGED}, u AS (SELECT CAST(floor(fork_length_mm / 5) * 5 AS DOUBLE) AS length_bin, count(*) AS c FROM sv_fish
      WHERE species = 'co-w' AND nullif(gr_age, '') IS NULL AND fork_length_mm IS NOT NULL GROUP BY 1)
    SELECT age, round(sum(c * share), 6) AS expected_n FROM u JOIN shares USING (length_bin) GROUP BY 1""",
)
def expected_ages_of_unaged(t: Tables) -> DataFrame:
    return rounded(report.expected_ages(t.fish))


_LINE = """count(*)::DOUBLE AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, avg(x) AS mean_x, avg(y) AS mean_y,
  regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy"""
_LINE_SE = """fit AS (SELECT *, sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) AS residual_sd FROM line)"""
_LINE_COLUMNS = """n, round(slope, 8) AS slope, round(intercept, 6) AS intercept, round(r2, 8) AS r2, round(residual_sd, 8) AS residual_sd,
  round(residual_sd / sqrt(sxx), 10) AS se_slope, round(residual_sd * sqrt(1 / n + mean_x * mean_x / sxx), 6) AS se_intercept"""


def _line(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "n", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 8).alias("r2"),
        F.round("residual_sd", 8).alias("residual_sd"), F.round("se_slope", 10).alias("se_slope"),
        F.round("se_intercept", 6).alias("se_intercept"),
    )


@query(
    "MOD-01 SCL-16 P50",
    f"""WITH line AS (SELECT {_LINE} FROM (SELECT log10(fork_length_mm) AS x, log10(weight_g) AS y FROM sv_fish WHERE {_MEASURED})),
    {_LINE_SE} SELECT {_LINE_COLUMNS} FROM fit""",
)
def weight_length_regression(t: Tables) -> DataFrame:
    return _line(report.weight_length_fit(t.fish))


@query(
    "MOD-10 P50",
    f"""WITH line AS (SELECT {_LINE} FROM (SELECT log10(fork_length_mm) AS x, log10(weight_g) AS y FROM sv_fish WHERE {_MEASURED}))
    SELECT v.length, round(pow(10, intercept + slope * log10(v.length)), 8) AS weight
    FROM line, (VALUES (60.0::DOUBLE), (85.0), (115.0), (190.0)) AS v(length)""",
)
def predicted_weights(t: Tables) -> DataFrame:
    return rounded(report.predicted_weight(report.weight_length_fit(t.fish), [60, 85, 115, 190]), 8)


@query(
    "MOD-03 P26",
    f"""WITH line AS (SELECT gr_age, {_LINE} FROM (SELECT gr_age, (date - DATE '1970-01-01')::DOUBLE AS x, fork_length_mm AS y FROM sv_wild
        WHERE gr_age IN ('22', '33', '44') AND fork_length_mm >= 70) GROUP BY 1),
    {_LINE_SE} SELECT gr_age, {_LINE_COLUMNS} FROM fit""",
)
def length_lines_by_age(t: Tables) -> DataFrame:
    return _line(report.length_by_age_lines(t.wild), "gr_age")


@query(
    "MOD-03",
    f"""WITH line AS (SELECT {_LINE} FROM (SELECT log10(fork_length_mm) AS x, log10(weight_g) AS y FROM sv_fish WHERE {_MEASURED})), {_LINE_SE}
    SELECT v.x, round(intercept + slope * v.x, 8) AS fitted, round(residual_sd * sqrt(1 / n + (v.x - mean_x) * (v.x - mean_x) / sxx), 10) AS se_fitted
    FROM fit, (VALUES (1.7::DOUBLE), (1.9), (2.1)) AS v(x)""",
)
def fitted_line_with_band(t: Tables) -> DataFrame:
    points = F.explode(F.array(F.lit(1.7), F.lit(1.9), F.lit(2.1)))
    band = regression.line_band(report.weight_length_fit(t.fish), points)
    return band.select("x", F.round("fitted", 8).alias("fitted"), F.round("se_fitted", 10).alias("se_fitted"))


_FACTOR = """g AS (SELECT f, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
  FROM obs WHERE x IS NOT NULL AND y IS NOT NULL AND f IS NOT NULL GROUP BY 1),
tot AS (SELECT sum(sxx) AS sxx, sum(sxy) / sum(sxx) AS b, sum(n) - count(*) - 1 AS df,
  (sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*) - 1) AS s2, arg_min(n, f) AS n0, arg_min(mx, f) AS mx0, arg_min(my, f) AS my0,
  min(f) AS f0 FROM g),
coefs AS (SELECT 'slope' AS term, b AS estimate, sqrt(s2 / sxx) AS std_error, df FROM tot
  UNION ALL SELECT 'intercept', my0 - b * mx0, sqrt(s2 * (1 / n0 + mx0 * mx0 / sxx)), df FROM tot
  UNION ALL SELECT '{name}=' || f, (my - b * mx) - (my0 - b * mx0), sqrt(s2 * (1 / n + 1 / n0 + (mx - mx0) * (mx - mx0) / tot.sxx)), df
    FROM g, tot WHERE f <> f0),
-- two-sided tail of Student's t: Simpson's rule over the density from 0 to |t|
tails AS (SELECT *, least(abs(estimate / std_error), 40) AS t FROM coefs),
tail AS (SELECT term, 1 - 2 * t / 12000 * sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * ln(1 + pow(t * i / 4000, 2) / df)) / sqrt(df * pi())) AS p
  FROM tails, range(4001) AS r(i) GROUP BY term, t, df)
SELECT term, round(estimate, 5) AS estimate, round(std_error, 6) AS std_error, df, round(estimate / std_error, 4) AS t_value,
  round(greatest(p, 0), 6) + 0.0 AS p_value FROM coefs JOIN tail USING (term)"""


def _coefficients(df: DataFrame) -> DataFrame:
    return df.select(
        "term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 6).alias("std_error"), "df",
        F.round("t_value", 4).alias("t_value"), F.round("p_value", 6).alias("p_value"),
    )


@query(
    "MOD-02 P05 AGG-09",
    """WITH obs AS (SELECT (date - DATE '1970-01-01')::DOUBLE AS x, avg(water_temp_c) AS y, site AS f FROM sv_trap GROUP BY date, site), """
    + _FACTOR.replace("{name}", "site"),
)
def temperature_trend(t: Tables) -> DataFrame:
    return _coefficients(environment.temperature_trend(t.trap))


@query(
    "MOD-02 P26",
    """WITH obs AS (SELECT (date - DATE '1970-01-01')::DOUBLE AS x, fork_length_mm AS y, gr_age AS f FROM sv_wild WHERE gr_age IN ('22', '33', '44')), """
    + _FACTOR.replace("{name}", "gr_age"),
)
def length_by_age_model(t: Tables) -> DataFrame:
    return _coefficients(report.length_by_age_model(t.wild))


@query(
    "MOD-04 P27",
    """WITH c AS (SELECT CAST(year(date) AS INT) AS year, dayofyear(date)::DOUBLE AS cx, count(*)::DOUBLE AS n, sum(k) AS sy FROM sv_wild WHERE k IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, min(cx) OVER w AS lo, max(cx) OVER w AS hi, sum(n) OVER w AS total FROM c WINDOW w AS (PARTITION BY year)),
    p AS (SELECT r.*, i, lo + (hi - lo) * i / 79.0::DOUBLE AS x, abs(cx - (lo + (hi - lo) * i / 79.0::DOUBLE)) AS d FROM r, range(80) AS g(i)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY year, i ORDER BY d RANGE UNBOUNDED PRECEDING) AS seen FROM p),
    h AS (SELECT *, min(CASE WHEN seen >= floor(total * 0.75 + 1e-5) THEN d END) OVER (PARTITION BY year, i) AS reach FROM s),
    w AS (SELECT *, pow(1 - pow(d / reach, 3), 3) AS w, cx - x AS c FROM h WHERE d < reach),
    m AS (SELECT year, i, x, sum(w * n) AS m0, sum(w * n * c) AS m1, sum(w * n * c * c) AS m2, sum(w * n * c * c * c) AS m3, sum(w * n * c * c * c * c) AS m4,
      sum(w * sy) AS b0, sum(w * sy * c) AS b1, sum(w * sy * c * c) AS b2 FROM w GROUP BY 1, 2, 3)
    SELECT year, round(x, 6) AS x, round((b0 * (m2 * m4 - m3 * m3) - m1 * (b1 * m4 - b2 * m3) + m2 * (b1 * m3 - b2 * m2))
      / (m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2)), 6) AS smooth FROM m""",
)
def condition_over_season(t: Tables) -> DataFrame:
    """Smoothed condition factor by day of year, one curve per year."""
    return rounded(report.condition_over_season(t.wild))


@query(
    "MOD-05 P51",
    f"WITH {_K} SELECT round(ceil(k / 0.05::DOUBLE - 0.5::DOUBLE) * 0.05::DOUBLE, 6) AS bin, count(*) AS n FROM k GROUP BY 1",
)
def condition_histogram(t: Tables) -> DataFrame:
    return rounded(report.condition_histogram(t.fish))


@query(
    "MOD-05",
    """SELECT year, species, ceil((date - DATE '1970-01-01') / 5.0::DOUBLE - 0.5::DOUBLE) * 5 AS bin, count(*) AS n FROM sv_fish GROUP BY 1, 2, 3""",
)
def five_day_histogram(t: Tables) -> DataFrame:
    return histograms.fixed_width(t.fish, F.unix_date("date"), 5, ["year", "species"])


@query(
    "MOD-06",
    """WITH r AS (SELECT (max(weight_g) - min(weight_g)) / 29.0::DOUBLE AS w FROM sv_fish)
       SELECT site, CAST(ceil(weight_g / w - 0.5::DOUBLE) AS BIGINT) AS bin_no, count(*) AS n, round(ceil(weight_g / w - 0.5::DOUBLE) * w, 8) AS bin
       FROM sv_fish, r WHERE weight_g IS NOT NULL GROUP BY 1, 2, 4""",
)
def thirty_bin_histogram(t: Tables) -> DataFrame:
    return rounded(histograms.fixed_count(t.fish, "weight_g", 30, ["site"]), 8)


@query(
    "MOD-07",
    """SELECT iso_year, year_day, site, a_caudalclip, CASE WHEN site = 'fence' THEN -coalesce(sum(count), 0) ELSE coalesce(sum(count), 0) END AS total
       FROM sv_wild GROUP BY 1, 2, 3, 4""",
)
def mirrored_bars(t: Tables) -> DataFrame:
    return histograms.stacked_bars(t.wild, "year_day", "a_caudalclip", "count", ["iso_year", "site"], F.col("site") == "fence")


@query(
    "MOD-08",
    """WITH q AS (SELECT gr_age, count(weight_g) AS n, quantile_cont(weight_g, 0.25) AS a, quantile_cont(weight_g, 0.5) AS m, quantile_cont(weight_g, 0.75) AS b
         FROM sv_fish WHERE weight_g IS NOT NULL GROUP BY 1)
       SELECT f.gr_age, n, round(a, 8) AS lower, round(m, 8) AS middle, round(b, 8) AS upper,
         round(min(weight_g) FILTER (WHERE weight_g BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 8) AS whisker_low,
         round(max(weight_g) FILTER (WHERE weight_g BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 8) AS whisker_high,
         count(*) FILTER (WHERE weight_g NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS n_outliers
       FROM sv_fish f JOIN q ON f.gr_age IS NOT DISTINCT FROM q.gr_age WHERE weight_g IS NOT NULL GROUP BY 1, 2, a, m, b""",
)
def box_summary_by_age(t: Tables) -> DataFrame:
    return rounded(histograms.box_summary(t.fish, "weight_g", ["gr_age"]), 8)
