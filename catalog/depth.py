"""Bands, ages of single animals, skew-safe joins, window tables, stored series and the two-way table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.domain import _MATRIX
from catalog.registry import query, rounded
from catalog.sources import scratch_folder
from catalog.tables import Tables
from tallyweir.functions import dates
from tallyweir.operators import joins, profile, recapture
from tallyweir.plans import marks, report
from tallyweir.sources import readers, writers

_POINTS = """WITH c AS (SELECT CAST(year(date) AS INT) AS year, dayofyear(date)::DOUBLE AS cx, count(*)::DOUBLE AS n, sum(k) AS sy, sum(k * k) AS syy
    FROM sv_wild WHERE k IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT year, min(cx) AS lo, max(cx) AS hi, sum(n) AS total FROM c GROUP BY 1),
  p AS (SELECT year, true AS even, lo + (hi - lo) * i / 79.0::DOUBLE AS x, total FROM b, range(80) AS g(i)
    UNION ALL SELECT year, false, cx, total FROM c JOIN b USING (year)),
  d AS (SELECT p.*, cx, n, sy, abs(cx - x) AS d FROM p JOIN c USING (year)),
  s AS (SELECT *, sum(n) OVER (PARTITION BY year, even, x ORDER BY d RANGE UNBOUNDED PRECEDING) AS seen FROM d),
  h AS (SELECT *, min(CASE WHEN seen >= floor(total * 0.75 + 1e-5) THEN d END) OVER (PARTITION BY year, even, x) AS reach FROM s),
  w AS (SELECT *, pow(1 - pow(d / reach, 3), 3) AS w, cx - x AS c FROM h WHERE d < reach),
  m AS (SELECT year, even, x, sum(w * n) AS m0, sum(w * n * c) AS m1, sum(w * n * c * c) AS m2, sum(w * n * c * c * c) AS m3, sum(w * n * c * c * c * c) AS m4 FROM w GROUP BY ALL),
  l AS (SELECT w.*, w.w * ((m2 * m4 - m3 * m3) - (m1 * m4 - m2 * m3) * c + (m1 * m3 - m2 * m2) * c * c)
      / (m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2)) AS l FROM w JOIN m USING (year, even, x)),
  f AS (SELECT year, even, x, sum(l * sy) AS smooth, sum(n * l * l) AS norm, sum(CASE WHEN cx = x THEN l END) AS own FROM l GROUP BY ALL),
  t AS (SELECT f.year, sum(c.syy - 2 * smooth * c.sy + c.n * smooth * smooth) AS rss, sum(c.n) AS total, sum(c.n * own) AS parameters, sum(c.n * norm) AS sq
    FROM f JOIN c ON f.year = c.year AND f.x = c.cx WHERE NOT even GROUP BY 1)"""


@query(
    "MOD-04 P27",
    f"""{_POINTS} SELECT f.year, round(x, 6) AS x, round(smooth, 6) AS smooth, round(sqrt(rss / (total - 2 * parameters + sq)) * sqrt(norm), 8) AS se,
      round(sqrt(rss / (total - 2 * parameters + sq)), 6) AS residual_sd, round(parameters, 5) AS parameters, round(total - 2 * parameters + sq, 4) AS residual_df
    FROM f JOIN t USING (year) WHERE even""",
)
def condition_band(t: Tables) -> DataFrame:
    """The seasonal curve with its standard error."""
    out = report.condition_band(t.wild)
    digits = {"x": 6, "smooth": 6, "se": 8, "residual_sd": 6, "parameters": 5, "residual_df": 4}
    return out.select("year", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "MOD-03 P26",
    """WITH obs AS (SELECT gr_age, (date - DATE '1970-01-01')::DOUBLE AS x, fork_length_mm AS y FROM sv_wild
      WHERE gr_age IN ('22', '33', '44') AND fork_length_mm >= 70 AND date IS NOT NULL),
    line AS (SELECT gr_age, count(*)::DOUBLE AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
      regr_sxy(y, x) AS sxy, min(x) AS lo, max(x) AS hi FROM obs GROUP BY 1),
    g AS (SELECT *, lo + (hi - lo) * i / 19.0::DOUBLE AS x, sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) AS s FROM line, range(20) AS r(i))
    SELECT gr_age, round(x, 4) AS x, round(intercept + slope * x, 4) AS fitted, round(s * sqrt(1 / n + (x - mx) * (x - mx) / sxx), 6) AS se_fitted FROM g""",
)
def length_by_age_bands(t: Tables) -> DataFrame:
    """The line of every age with its standard error, on an even grid over the dates of the age."""
    out = report.length_by_age_band(t.wild)
    return out.select("gr_age", F.round("x", 4).alias("x"), F.round("fitted", 4).alias("fitted"), F.round("se_fitted", 6).alias("se_fitted"))


def _apportioned(aged: str, unaged: str) -> str:
    """CTEs: whole numbers of unaged animals per bin and age, with ranks inside the bin."""
    return f"""key AS (SELECT length_bin, age, count(*) AS n FROM {aged} WHERE length_bin IS NOT NULL GROUP BY 1, 2),
    tot AS (SELECT *, sum(n) OVER (PARTITION BY length_bin) AS row_total FROM key),
    u AS (SELECT length_bin, count(*) AS c FROM {unaged} GROUP BY 1),
    cut AS (SELECT k.length_bin, age, c, (c * n) // row_total AS whole, (c * n) % row_total AS rest FROM tot k JOIN u ON k.length_bin = u.length_bin),
    full_ AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY length_bin ORDER BY rest DESC, age) <= c - sum(whole) OVER (PARTITION BY length_bin) THEN 1 ELSE 0 END AS n_ages FROM cut),
    ranks AS (SELECT *, sum(n_ages) OVER (PARTITION BY length_bin ORDER BY age) AS to_rank FROM full_)"""


@query(
    "DOM-22 P49",
    f"""WITH a AS (SELECT CAST(floor(fork_length_mm / 5) * 5 AS DOUBLE) AS length_bin, TRY_CAST(nullif(gr_age, '') AS INT) AS age FROM sv_fish
      WHERE species = 'co-w' AND TRY_CAST(nullif(gr_age, '') AS INT) IN (22, 33, 44)),
    un AS (SELECT row_label, fork_length_mm, CAST(floor(fork_length_mm / 5) * 5 AS DOUBLE) AS length_bin FROM sv_fish
      WHERE species = 'co-w' AND nullif(gr_age, '') IS NULL AND fork_length_mm IS NOT NULL),
    {_apportioned('a', 'un')},
    r AS (SELECT *, row_number() OVER (PARTITION BY length_bin ORDER BY fork_length_mm, row_label) AS rank FROM un)
    SELECT row_label, fork_length_mm, r.length_bin, age AS assigned_age FROM r
      LEFT JOIN ranks k ON r.length_bin = k.length_bin AND r.rank > k.to_rank - k.n_ages AND r.rank <= k.to_rank""",
)
def ages_of_unaged_animals(t: Tables) -> DataFrame:
    """One age for every unaged animal."""
    return report.ages_of_unaged(t.fish).select("row_label", "fork_length_mm", "length_bin", "assigned_age")


_GROWN = """g AS (SELECT year, row_label, gr_age, dayofyear(date)::DOUBLE AS x, fork_length_mm::DOUBLE AS y, TRY_CAST(nullif(gr_age, '') AS INT) AS age, species FROM sv_fish),
    lv AS (SELECT year, age, count(*)::DOUBLE AS n, avg(x) AS mx, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM g
      WHERE species = 'co-w' AND age IN (22, 33, 44) AND x IS NOT NULL AND y IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2),
    se AS (SELECT year, sum(sxy) / nullif(sum(sxx), 0) AS growth, sum(n * mx) / sum(n) AS day FROM lv GROUP BY 1),
    co AS (SELECT g.*, y - coalesce(growth * (x - day), 0) AS z FROM g LEFT JOIN se ON g.year = se.year)"""


@query(
    "DOM-22 MOD-02 P49",
    f"WITH {_GROWN} SELECT row_label, round(z, 6) AS corrected_length FROM co WHERE species = 'co-w'",
)
def growth_corrected_lengths(t: Tables) -> DataFrame:
    """Lengths as of the season's mean day, before the key is applied."""
    out = report.with_growth_correction(t.fish.where("species = 'co-w'"))
    return out.select("row_label", F.round("corrected_length", 6).alias("corrected_length"))


@query(
    "DOM-22 P49",
    f"""WITH {_GROWN}, b AS (SELECT *, CAST(floor(round(z, 9) / 5) * 5 AS DOUBLE) AS length_bin FROM co WHERE species = 'co-w'),
    a AS (SELECT * FROM b WHERE age IN (22, 33, 44)), un AS (SELECT * FROM b WHERE nullif(gr_age, '') IS NULL AND z IS NOT NULL),
    {_apportioned('a', 'un')}
    SELECT age AS assigned_age, CAST(sum(n_ages) AS BIGINT) AS n FROM ranks WHERE n_ages > 0 GROUP BY 1
    UNION ALL SELECT NULL, count(*) FROM un WHERE length_bin NOT IN (SELECT length_bin FROM ranks) HAVING count(*) > 0""",
)
def ages_after_growth_correction(t: Tables) -> DataFrame:
    """Animals per assigned age, the key made and applied on corrected lengths."""
    fish = report.with_growth_correction(t.fish.where("species = 'co-w'")).withColumn("corrected_length", F.round("corrected_length", 9))
    out = report.ages_of_unaged(fish, length="corrected_length")
    return out.groupBy("assigned_age").agg(F.count(F.lit(1)).alias("n"))


@query(
    "JOI-05",
    """WITH a AS (SELECT c_nationkey AS nation, c_custkey FROM customer WHERE c_nationkey <> 3 AND c_custkey % 3 = 0),
    b AS (SELECT c_nationkey AS nation, c_custkey AS other_key FROM customer WHERE c_nationkey <> 5 AND c_custkey % 10 = 1)
    SELECT nation, c_custkey, other_key FROM a FULL JOIN b USING (nation)""",
)
def full_join_with_hot_keys(t: Tables) -> DataFrame:
    """Many-to-many full join whose large keys are dealt to parts."""
    customers = t.raw("customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    left = customers.where("nation <> 3 AND c_custkey % 3 = 0")
    right = customers.where("nation <> 5 AND c_custkey % 10 = 1").withColumnRenamed("c_custkey", "other_key")
    return joins.skew_safe_full_join(left, right, ["nation"], most_rows=5)


@query(
    "FLT-05",
    """WITH w AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, min(CAST(o_orderdate AS DATE)) + 400 AS b FROM orders GROUP BY 1
      UNION ALL SELECT o_custkey, max(CAST(o_orderdate AS DATE)) - 5, max(CAST(o_orderdate AS DATE)) FROM orders GROUP BY 1)
    SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders o
    WHERE EXISTS (SELECT 1 FROM w WHERE w.o_custkey = o.o_custkey AND CAST(o.o_orderdate AS DATE) BETWEEN a AND b)""",
)
def dates_in_window_table(t: Tables) -> DataFrame:
    """Orders inside the windows of their customer, two windows each."""
    day = F.col("o_orderdate").cast("date")
    orders = t.raw("orders").select("o_orderkey", "o_custkey", day.alias("date"))
    ends = orders.groupBy("o_custkey").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    pairs = F.inline(F.array(F.struct(F.col("a").alias("first"), F.date_add("a", 400).alias("last")), F.struct(F.date_sub("b", 5).alias("first"), F.col("b").alias("last"))))
    return joins.in_window_table(orders, ends.select("o_custkey", pairs), "date", ["o_custkey"])


@query(
    "SRC-07 FLT-07",
    """SELECT station_number, date, parameter, round(CASE WHEN year(date) = 1997 AND station_number = '2-HIGH' THEN value * 2 ELSE value END, 10) AS value
    FROM sv_hydro WHERE station_number IN ('2-HIGH', '1-URGENT') AND date BETWEEN DATE '1996-07-01' AND DATE '1998-02-28'""",
)
def stored_station_series(t: Tables) -> DataFrame:
    """A series stored by station and year, one year of one station rewritten, and a range of two stations read back."""
    folder = scratch_folder(t, "series")
    writers.store_series(t.hydro, folder)
    again = t.hydro.where((F.col("station_number") == "2-HIGH") & (F.year("date") == 1997))
    writers.store_series(again.withColumn("value", F.col("value") * 2), folder)
    chosen = readers.literal_table(t.spark, [("2-HIGH",), ("1-URGENT",)], "station_number STRING")
    series = readers.stored_series(t.spark, folder, chosen, "1996-07-01", "1998-02-28")
    return rounded(series.select("station_number", "date", "parameter", "value"), 10)


_WEEKS = range(19, 27)
_COLUMNS = ", ".join(f"coalesce(sum(n) FILTER (WHERE c = 'w{w}'), 0) AS w{w}" for w in _WEEKS)


@query(
    "RSH-04 P35",
    f"""{_MATRIX}, x AS (SELECT iso_year, CASE WHEN kind = 'unmarked' THEN 'unmarked' ELSE concat('w', weekofyear(release_week)) END AS r,
      CASE WHEN kind = 'never' THEN 'never' ELSE concat('w', weekofyear(recover_week)) END AS c, n FROM matrix WHERE kind <> 'unassigned'),
    m AS (SELECT iso_year, r, c, n FROM x UNION ALL SELECT iso_year, 'total', c, n FROM x)
    SELECT iso_year, r AS "release", {", ".join(f"round(w{w}, 6) + 0.0 AS w{w}" for w in _WEEKS)}, round(never, 6) + 0.0 AS never, round(total, 6) AS total
    FROM (SELECT iso_year, r, {_COLUMNS}, coalesce(sum(n) FILTER (WHERE c = 'never'), 0) AS never, sum(n) AS total FROM m GROUP BY 1, 2)""",
)
def release_recovery_table(t: Tables) -> DataFrame:
    """The release by recovery table with both margins; weeks 19 to 26 have columns of their own."""
    label = lambda week: F.concat(F.lit("w"), dates.iso_week(week).cast("string"))
    table = recapture.two_way_table(marks.mark_matrix(t.wild), [f"w{w}" for w in _WEEKS], label, ["iso_year"])
    return rounded(table)




_WIDE = ("site", "species", "gr_age", "a_adclip", "r_adclip", "tag_code", "head_mold_size", "scale_number", "count", "mort", "row_label", "fork_length_mm")
_DISTINCT = "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM sv_fish" for c in _WIDE)


@query("AGG-23 AGG-07", _DISTINCT)
def distinct_counts_by_slices(t: Tables) -> DataFrame:
    """Exact distinct counts of many columns, two hash slices."""
    return profile.exact_distinct_counts(t.fish, _WIDE, slices=2)


_PROFILED = _WIDE[:10]


@query(
    "AGG-23",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n_known, count(*) - count({c}) AS n_missing, true AS distinct_within_error,
        CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 1000 THEN (SELECT max(n) FROM (SELECT count(*) AS n FROM sv_fish WHERE {c} IS NOT NULL GROUP BY {c})) END AS largest_count FROM sv_fish"""
        for c in _PROFILED
    ),
)
def column_sketch_profile(t: Tables) -> DataFrame:
    """Sketches per year, stored by column and merged; the distinct counts are held against the exact ones."""
    fish = t.fish.select("year", *_PROFILED)
    merged = profile.merged_profile(profile.column_sketches(fish, _PROFILED, ["year"]), top=1)
    both = merged.join(profile.exact_distinct_counts(fish, _PROFILED), "column_name")
    near = F.abs(F.col("n_distinct_approx") - F.col("n_distinct")) <= 4 * profile.DISTINCT_ERROR * F.col("n_distinct") + 1
    few = F.col("n_distinct").between(1, 1000)
    # a column of very many values may have no frequent one; the optimizer takes the count out before it asks for few values
    return both.select("column_name", "n_known", "n_missing", near.alias("distinct_within_error"), F.when(few, F.get("most_frequent", 0)["count"]).alias("largest_count"))
