"""Fits of the stratified model and their ranking. The SQL twin solves the model in another way than the library.

The library takes damped Newton steps. The twin iterates the EM step in pooled sufficient statistics as a recursive
query over long cells, with an extrapolated step every two plain ones, until the group stands still; the standard error
comes from the information matrix with the weeks eliminated in closed form and the pools by Gauss-Jordan steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.domain import _SHARED
from catalog.registry import query
from catalog.tables import Tables
from tallyweir.operators import bootstrap, fixed_point
from tallyweir.plans import estimates, marks

#: Rounds of one extrapolated step; a fit that is not there by then has a rate that runs to a boundary.
ROUNDS = fixed_point.ROUNDS


def _step(source: str, old: str, new: str) -> str:
    """One EM step from column ``old`` to column ``new``."""
    return f"""(SELECT * EXCLUDE (all_w, x), u * x / nullif(sum(x) OVER (PARTITION BY iso_year, model_id, c), 0) AS {new}
      FROM (SELECT *, all_w / (all_w + m_pool) * (m + {old}) AS x
        FROM (SELECT *, sum({old}) OVER (PARTITION BY iso_year, model_id, pool) AS all_w FROM {source})))"""


_LEAP = f"""(SELECT *, CASE WHEN bool_or(leap < 0) OVER g THEN w2 ELSE leap END AS w3 FROM (
      SELECT *, w + 2 * far * (w1 - w) + far * far * (w2 - 2 * w1 + w) AS leap FROM (
        SELECT *, greatest(1, coalesce(sqrt(sum((w1 - w) * (w1 - w)) OVER g) / nullif(sqrt(sum((w2 - 2 * w1 + w) * (w2 - 2 * w1 + w)) OVER g), 0), 1)) AS far,
          max(abs(w1 - w)) OVER g / (1 + max(u) OVER g) AS step
        FROM {_step(_step("(SELECT * FROM em WHERE k < " + str(ROUNDS) + " AND gap > 1e-11)", "w", "w1"), "w1", "w2")}
        WINDOW g AS (PARTITION BY iso_year, model_id)))
      WINDOW g AS (PARTITION BY iso_year, model_id))"""

_CELLS = f"""{_SHARED.replace("WITH ", "WITH RECURSIVE ", 1)},
own AS (SELECT * FROM matrix WHERE kind <> 'unassigned'),
named AS (SELECT iso_year, stratum, 'Logical pooling to single row (LP)' AS model_id, 'all' AS pool FROM pools_r
  UNION ALL SELECT iso_year, stratum, 'Full weekly strata', CAST(stratum AS VARCHAR) FROM pools_r
  UNION ALL SELECT iso_year, stratum, 'Auto (logical) pooling', CAST(pool AS VARCHAR) FROM pools_r),
filled AS (SELECT DISTINCT iso_year, recover_week AS c FROM own WHERE kind = 'recovered' AND n > 0),
caught AS (SELECT iso_year, c, coalesce(sum(n), 0) AS u FROM filled LEFT JOIN (
    SELECT o.iso_year, coalesce(max(f.c) FILTER (WHERE f.c <= o.recover_week), min(f.c)) AS c, any_value(o.n) AS n
    FROM own o JOIN filled f ON o.iso_year = f.iso_year WHERE kind = 'unmarked' GROUP BY o.iso_year, o.recover_week) USING (iso_year, c) GROUP BY 1, 2),
marked AS (SELECT o.iso_year, n.model_id, n.pool, o.recover_week AS c, o.n, o.kind FROM own o JOIN named n
  ON o.iso_year = n.iso_year AND o.release_week = n.stratum WHERE o.kind IN ('recovered', 'never')),
pooled AS (SELECT iso_year, model_id, pool, sum(n) AS released, coalesce(sum(n) FILTER (WHERE kind = 'recovered'), 0) AS m_pool FROM marked GROUP BY ALL),
sizes AS (SELECT iso_year, model_id, count(*) AS n_pools, bool_and(m_pool > 0) AS usable, string_agg(pool, ',' ORDER BY pool) AS pools FROM pooled GROUP BY ALL),
cells_m AS (SELECT iso_year, model_id, pool, c, sum(n) AS m FROM marked WHERE kind = 'recovered' GROUP BY ALL),
em AS (SELECT iso_year, model_id, pool, c, m, u, m_pool, u * m / sum(m) OVER (PARTITION BY iso_year, model_id, c) AS w, 0 AS k, CAST(1 AS DOUBLE) AS gap
    FROM cells_m JOIN caught USING (iso_year, c) JOIN pooled USING (iso_year, model_id, pool) JOIN sizes USING (iso_year, model_id)
    WHERE usable AND iso_year IN (SELECT iso_year FROM caught GROUP BY 1 HAVING sum(u) > 0)
  UNION ALL
  SELECT iso_year, model_id, pool, c, m, u, m_pool, w4, k + 1, step FROM {_step(_LEAP, "w3", "w4")}),
last AS (SELECT * FROM em QUALIFY k = max(k) OVER (PARTITION BY iso_year, model_id)),
rates AS (SELECT iso_year, model_id, pool, any_value(m_pool) AS m_pool, sum(w) / any_value(m_pool) AS beta, max(gap) <= 1e-11 AS still FROM last GROUP BY ALL),
free AS (SELECT iso_year, model_id FROM rates GROUP BY ALL HAVING bool_and(still) AND min(beta) > 1e-6),
theta AS (SELECT iso_year, model_id, pool, c, m, u, beta, (m + w) / (1 + beta) AS t FROM last JOIN rates USING (iso_year, model_id, pool) JOIN free USING (iso_year, model_id)),
weeks AS (SELECT iso_year, model_id, c, any_value(u) AS u, sum(beta * t) AS mu FROM theta GROUP BY ALL),
n_hats AS (SELECT iso_year, model_id, sum((1 + beta) * released) AS n_hat, sum((1 + beta) * (1 + beta) * greatest(released - p.m_pool, 0)) AS unseen,
    min(1 / (1 + beta)) AS least_p, max(1 / (1 + beta)) AS largest_p
  FROM rates JOIN pooled p USING (iso_year, model_id, pool) JOIN free USING (iso_year, model_id) GROUP BY ALL),
fitted AS (SELECT x.iso_year, x.model_id, x.n, x.n * t / m AS f FROM marked x JOIN theta t USING (iso_year, model_id, pool, c) WHERE kind = 'recovered'),
parts AS (SELECT iso_year, model_id, n * ln(f) - f - lgamma(n + 1) AS l, (n - f) * (n - f) / f AS x, n AS a FROM fitted
  UNION ALL SELECT iso_year, model_id, CASE WHEN mu > 0 THEN u * ln(mu) - mu - lgamma(u + 1) ELSE 0 END, CASE WHEN mu > 0 THEN (u - mu) * (u - mu) / mu ELSE 0 END, u FROM weeks
  UNION ALL SELECT iso_year, model_id, CASE WHEN n > 0 THEN n * ln(n) - n - lgamma(n + 1) ELSE 0 END, 0, n FROM marked WHERE kind = 'never'),
sums AS (SELECT iso_year, model_id, sum(l) AS log_lik, sum(x) AS chisq, sum(a) AS n_all FROM parts JOIN free USING (iso_year, model_id) GROUP BY ALL),
shape AS (SELECT iso_year, count(DISTINCT release_week) FILTER (WHERE kind IN ('recovered', 'never')) AS n_rows,
    count(DISTINCT recover_week) FILTER (WHERE kind IN ('recovered', 'unmarked')) AS weeks,
    count(DISTINCT recover_week) FILTER (WHERE kind = 'recovered') AS filled, count(*) FILTER (WHERE kind = 'recovered') AS cells,
    count(*) FILTER (WHERE kind = 'never' AND n < 0) AS overdrawn FROM own GROUP BY 1),
busy AS (SELECT iso_year, count(*) FILTER (WHERE u > 0) AS n FROM caught GROUP BY 1),
shaped AS (SELECT iso_year, model_id, n_rows, CASE WHEN filled = 0 THEN weeks ELSE filled END AS n_cols, n_pools, pools,
    CASE WHEN filled = 0 THEN 0 ELSE weeks - filled END AS merged_weeks, overdrawn,
    CASE WHEN usable AND busy.n > 0 THEN cells + n_rows + n_pools END AS np, CASE WHEN usable AND busy.n > 0 THEN busy.n - n_pools END AS gof_df
  FROM sizes JOIN shape USING (iso_year) LEFT JOIN busy USING (iso_year))"""

# Information matrix over (theta, beta): in a week theta has a diagonal and one outer product, so it is eliminated in closed form.
_ERRORS = """
fisher AS (SELECT t.*, mu, t.m / (t.t * t.t) AS d, CASE WHEN t.u > 0 AND mu > 0 THEN t.u / (mu * mu) ELSE 0 END AS f,
    CASE WHEN t.u > 0 AND mu > 0 THEN 1 - t.u / mu ELSE 0 END AS e FROM theta t JOIN weeks USING (iso_year, model_id, c)),
week_sums AS (SELECT iso_year, model_id, c, any_value(f) AS f, sum(beta * beta / d) AS s, sum(beta * (1 + beta) / d) AS pa, sum((1 + beta) * (1 + beta) / d) AS qa
  FROM fisher GROUP BY ALL),
across AS (SELECT g.iso_year, g.model_id, g.c, g.pool AS g, h.pool AS h, g.d, g.beta, g.f * g.beta * h.t + CASE WHEN g.pool = h.pool THEN g.e ELSE 0 END AS b
  FROM fisher g JOIN fisher h ON g.iso_year = h.iso_year AND g.model_id = h.model_id AND g.c = h.c),
cols AS (SELECT iso_year, model_id, c, h, sum(beta * b / d) AS p, sum((1 + beta) * b / d) AS r FROM across GROUP BY ALL),
squares AS (SELECT x.iso_year, x.model_id, x.c, x.h, y.h AS k, sum(x.b * y.b / x.d) AS q FROM across x JOIN across y
    ON x.iso_year = y.iso_year AND x.model_id = y.model_id AND x.c = y.c AND x.g = y.g GROUP BY ALL),
schur AS (SELECT q.iso_year, q.model_id, q.h, q.k, sum(w.f * fh.t * fk.t - q.q + w.f * ph.p * pk.p / (1 + w.f * w.s)) AS v
  FROM squares q JOIN week_sums w USING (iso_year, model_id, c)
    JOIN cols ph ON ph.iso_year = q.iso_year AND ph.model_id = q.model_id AND ph.c = q.c AND ph.h = q.h
    JOIN cols pk ON pk.iso_year = q.iso_year AND pk.model_id = q.model_id AND pk.c = q.c AND pk.h = q.k
    JOIN theta fh ON fh.iso_year = q.iso_year AND fh.model_id = q.model_id AND fh.c = q.c AND fh.pool = q.h
    JOIN theta fk ON fk.iso_year = q.iso_year AND fk.model_id = q.model_id AND fk.c = q.c AND fk.pool = q.k GROUP BY ALL),
right_side AS (SELECT p.iso_year, p.model_id, p.pool AS h, any_value(p.released) - sum(x.r - w.f * x.p * w.pa / (1 + w.f * w.s)) AS v
  FROM pooled p JOIN cols x ON x.iso_year = p.iso_year AND x.model_id = p.model_id AND x.h = p.pool
    JOIN week_sums w ON w.iso_year = p.iso_year AND w.model_id = p.model_id AND w.c = x.c GROUP BY ALL),
numbers AS (SELECT iso_year, model_id, pool, row_number() OVER (PARTITION BY iso_year, model_id ORDER BY pool) AS i, count(*) OVER (PARTITION BY iso_year, model_id) AS n
  FROM pooled JOIN free USING (iso_year, model_id)),
gauss AS (SELECT x.iso_year, x.model_id, x.i, y.i AS j, x.n, coalesce(s.v, 0) AS v, CAST(1 AS BIGINT) AS turn FROM numbers x JOIN numbers y USING (iso_year, model_id)
    LEFT JOIN schur s ON s.iso_year = x.iso_year AND s.model_id = x.model_id AND s.h = x.pool AND s.k = y.pool
  UNION ALL SELECT x.iso_year, x.model_id, x.i, x.n + 1, x.n, r.v, 1 FROM numbers x JOIN right_side r ON r.iso_year = x.iso_year AND r.model_id = x.model_id AND r.h = x.pool),
solved AS (SELECT * FROM gauss
  UNION ALL
  SELECT iso_year, model_id, i, j, n, CASE WHEN i = turn THEN v / lead_v ELSE v - own_row * own_col / lead_v END, turn + 1 FROM (
    SELECT *, max(v) FILTER (WHERE i = turn AND j = turn) OVER (PARTITION BY iso_year, model_id) AS lead_v,
      max(v) FILTER (WHERE j = turn) OVER (PARTITION BY iso_year, model_id, i) AS own_row, max(v) FILTER (WHERE i = turn) OVER (PARTITION BY iso_year, model_id, j) AS own_col
    FROM solved WHERE turn <= n)),
by_pools AS (SELECT s.iso_year, s.model_id, sum(s.v * r.v) AS v FROM solved s JOIN numbers x ON x.iso_year = s.iso_year AND x.model_id = s.model_id AND x.i = s.i
    JOIN right_side r ON r.iso_year = s.iso_year AND r.model_id = s.model_id AND r.h = x.pool WHERE s.turn = s.n + 1 AND s.j = s.n + 1 GROUP BY ALL),
by_weeks AS (SELECT iso_year, model_id, sum(qa - f * pa * pa / (1 + f * s)) AS v FROM week_sums GROUP BY ALL),
errors AS (SELECT iso_year, model_id, by_pools.v + by_weeks.v + unseen - n_hat AS variance FROM by_pools JOIN by_weeks USING (iso_year, model_id) JOIN n_hats USING (iso_year, model_id)),
simpson AS (SELECT iso_year, model_id, gof_df / 2.0 AS a, least(chisq, gof_df + 60 * sqrt(2.0 * gof_df)) / 2.0 AS z FROM sums JOIN shaped USING (iso_year, model_id) WHERE gof_df > 2),
tails AS (SELECT iso_year, model_id, greatest(0, 1 - z / 12000 * sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * CASE WHEN i = 0 THEN 0 ELSE exp((a - 1) * ln(z * greatest(i, 1) / 4000) - z * i / 4000 - lgamma(a)) END)) AS p FROM simpson, range(4001) AS r(i) GROUP BY iso_year, model_id, a, z),
fits AS (SELECT s.*, log_lik, CASE WHEN n_all - np - 1 > 0 THEN -2 * log_lik + 2 * np + 2 * np * (np + 1) / (n_all - np - 1) END AS aicc, chisq, p, n_hat,
    CASE WHEN variance > 0 THEN sqrt(variance) END AS se, least_p, largest_p
  FROM shaped s LEFT JOIN sums USING (iso_year, model_id) LEFT JOIN n_hats USING (iso_year, model_id) LEFT JOIN errors USING (iso_year, model_id)
    LEFT JOIN tails USING (iso_year, model_id))"""


def _fits(t: Tables) -> DataFrame:
    return estimates.candidate_fits(marks.mark_matrix(t.wild), shares=estimates.ROW_SHARES)


@query(
    "DOM-13 DOM-14 SET-03 P36",
    f"""{_CELLS}, {_ERRORS}
    SELECT iso_year, model_id, CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols, CAST(n_pools AS INT) AS n_pools, CAST(merged_weeks AS INT) AS merged_weeks,
      CAST(overdrawn AS INT) AS overdrawn_rows, pools, CAST(np AS INT) AS np, CAST(gof_df AS INT) AS gof_df, n_hat IS NOT NULL AS interior,
      round(log_lik, 3) AS log_lik, round(aicc, 3) AS aicc, round(chisq, 2) AS gof_chisq, round(p, 4) + 0.0 AS gof_p, round(n_hat, 1) AS n_hat, round(se, 1) AS n_hat_se,
      round(least_p, 6) AS least_capture_p, round(largest_p, 6) AS largest_capture_p FROM fits""",
)
def candidate_stratified_fits(t: Tables) -> DataFrame:
    """Three models for every season. A fit with a rate on its boundary, or without a fixed point, has no regular estimates."""
    fits = estimates.interior_only(_fits(t))
    return fits.select(
        "iso_year", "model_id", "n_rows", "n_cols", "n_pools", "merged_weeks", "overdrawn_rows", F.array_join("pools", ",").alias("pools"), "np", "gof_df",
        "interior", F.round("log_lik", 3).alias("log_lik"), F.round("aicc", 3).alias("aicc"), F.round("gof_chisq", 2).alias("gof_chisq"),
        F.round("gof_p", 4).alias("gof_p"), F.round("n_hat", 1).alias("n_hat"), F.round("n_hat_se", 1).alias("n_hat_se"),
        F.round(F.array_min("capture_p"), 6).alias("least_capture_p"), F.round(F.array_max("capture_p"), 6).alias("largest_capture_p"),
    )


@query(
    "DOM-15 WIN-02 SRT-05 P37",
    f"""{_CELLS}, {_ERRORS},
    deltas AS (SELECT *, round_even(aicc - min(aicc) OVER (PARTITION BY iso_year), 2) AS delta FROM fits)
    SELECT iso_year, CAST(CASE WHEN aicc IS NOT NULL THEN row_number() OVER (PARTITION BY iso_year ORDER BY delta NULLS LAST, model_id) END AS INT) AS rank, model_id,
      CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols, round(aicc, 3) AS aicc, delta AS delta_aicc, round_even(chisq, 1) AS gof_chisq,
      CAST(gof_df AS INT) AS gof_df, round_even(p, 3) + 0.0 AS gof_p, round_even(n_hat, 0) AS n_hat, round_even(se, 0) AS n_hat_se FROM deltas""",
)
def ranked_models(t: Tables) -> DataFrame:
    report = estimates.model_report(estimates.interior_only(_fits(t)))
    return report.withColumn("aicc", F.round("aicc", 3))


@query(
    "DOM-14 SET-03 P36",
    f"""{_CELLS} SELECT s.iso_year, s.model_id, CAST(s.n_pools AS INT) AS n_pools, n_hat IS NOT NULL AS still, round(n_hat, 1) AS n_hat,
      round(least_p, 6) AS least_capture_p, round(largest_p, 6) AS largest_capture_p FROM sizes s LEFT JOIN n_hats USING (iso_year, model_id)""",
)
def stratified_fixed_point(t: Tables) -> DataFrame:
    """The same fits by the fixed point of the EM step, which needs no matrix algebra and no Python in the tasks."""
    matrix = marks.mark_matrix(t.wild)
    fits = fixed_point.fixed_point_fits(estimates.candidate_cells(matrix, shares=estimates.ROW_SHARES), ["iso_year"])
    free = F.col("still") & (F.array_max("capture_p") < 1 - 1e-6)
    return fits.select(
        "iso_year", "model_id", "n_pools", free.alias("still"), F.when(free, F.round("n_hat", 1)).alias("n_hat"),
        F.when(free, F.round(F.array_min("capture_p"), 6)).alias("least_capture_p"), F.when(free, F.round(F.array_max("capture_p"), 6)).alias("largest_capture_p"),
    )


@query("DOM-14 SET-03 P36")
def boundary_abundance_intervals(t: Tables) -> DataFrame:
    """Bootstrap limits of the weekly model, which runs to its boundary; random, so checked by coverage in the tests."""
    cells = estimates.candidate_cells(marks.mark_matrix(t.wild), shares=estimates.ROW_SHARES)
    weekly = cells.where(F.col("model_id") == estimates.MODEL_NAMES["full"])
    return bootstrap.abundance_intervals(weekly, ["iso_year"], replicates=100)
