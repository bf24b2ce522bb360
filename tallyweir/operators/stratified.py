"""Stratified closed-population model, fitted for many seasons and models in parallel.

The data of one fit is a weekly matrix that Spark has aggregated already (tens of weeks), so a
group is small however large the observation table is. Model: marked recoveries in cell (i, j)
are Poisson(theta_ij), marked animals never seen again are Poisson(psi_i), unmarked catches are
Poisson(sum_i beta_g(i) theta_ij), where beta = (1 - p) / p is shared by the rows of a pool g.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.distributions import chi_square_tail
from tallyweir.operators.joins import left_join

FIT_COLUMNS = (
    "n_rows INT, n_cols INT, n_pools INT, merged_weeks INT, log_lik DOUBLE, np INT, aicc DOUBLE, gof_chisq DOUBLE, gof_df INT, "
    "gof_p DOUBLE, n_hat DOUBLE, n_hat_se DOUBLE, boundary BOOLEAN, converged BOOLEAN, overdrawn_rows INT, "
    "pools ARRAY<STRING>, capture_p ARRAY<DOUBLE>"
)


def _log_lik(beta, theta, m, u):
    mu = (beta[:, None] * theta).sum(axis=0)
    marks = np.where(m > 0, m * np.log(np.where(theta > 0, theta, 1.0)), 0.0).sum() - theta.sum()
    plain = np.where(u > 0, u * np.log(np.where(mu > 0, mu, 1.0)), 0.0).sum() - mu.sum()
    return marks + plain


def fit_pools(m: np.ndarray, u: np.ndarray, tolerance: float = 1e-9, max_steps: int = 500):
    """Maximum likelihood beta and theta by damped Fisher scoring on log scales.

    ``m`` is (pool, week); cells without recoveries are structural zeros. Every step solves one
    small linear system; the damping grows until the likelihood does not fall.
    """
    pools = m.shape[0]
    g, j = np.nonzero(m)
    cells = len(g)
    pool_of_cell = np.zeros((cells, pools))
    pool_of_cell[np.arange(cells), g] = 1.0
    same_week = j[:, None] == j[None, :]
    counts = m[g, j]
    log_theta = np.log(counts)
    log_beta = np.full(pools, math.log(max(u.sum(), 1.0) / m.sum()))
    floor = math.log(1e-12)

    def expand(a, b):
        theta = np.zeros_like(m, dtype=float)
        theta[g, j] = np.exp(a)
        return np.exp(b), theta

    beta, theta = expand(log_theta, log_beta)
    value = _log_lik(beta, theta, m, u)
    damping = 1e-3
    for _ in range(max_steps):
        mu = (beta[:, None] * theta).sum(axis=0)
        part = beta[g] * theta[g, j]
        pull = (u[j] / mu[j] - 1.0) * part
        slope = np.concatenate([counts - theta[g, j] + pull, pool_of_cell.T @ pull])
        if np.abs(slope).max() < tolerance * (1.0 + counts.sum()):
            return beta, theta, True
        shared = np.where(same_week, part[:, None] * part[None, :] / mu[j][None, :], 0.0)
        across = shared @ pool_of_cell
        info = np.block([[shared + np.diag(theta[g, j]), across], [across.T, pool_of_cell.T @ across]])
        size = np.diag(info).copy()
        moved = False
        while damping < 1e12:
            step = np.linalg.solve(info + np.diag(damping * size + 1e-12), slope)
            step = np.clip(step, -2.0, 2.0)
            a, b = log_theta + step[:cells], np.maximum(log_beta + step[cells:], floor)
            new_beta, new_theta = expand(a, b)
            new_value = _log_lik(new_beta, new_theta, m, u)
            if new_value >= value - 1e-12 * abs(value):
                moved = True
                break
            damping *= 10.0
        if not moved:
            break
        log_theta, log_beta, beta, theta, value = a, b, new_beta, new_theta, new_value
        damping = max(damping / 10.0, 1e-10)
    return beta, theta, False


def _abundance_variance(beta, theta, m, u, released):
    """Delta-method variance of N under Poisson sampling, less N for the closed population."""
    pools, weeks = m.shape
    free = [(g, j) for g in range(pools) for j in range(weeks) if m[g, j] > 0]
    at = {cell: k for k, cell in enumerate(free)}
    size = len(free) + pools
    mu = (beta[:, None] * theta).sum(axis=0)
    info = np.zeros((size, size))
    for (g, j), k in at.items():
        info[k, k] += m[g, j] / theta[g, j] ** 2
    for j in range(weeks):
        if u[j] <= 0 or mu[j] <= 0:
            continue
        slope = np.zeros(size)
        for g in range(pools):
            if (g, j) in at:
                slope[at[g, j]] = beta[g]
                slope[len(free) + g] = theta[g, j]
        info += u[j] / mu[j] ** 2 * np.outer(slope, slope)
        for g in range(pools):
            if (g, j) in at:
                a, b = at[g, j], len(free) + g
                info[a, b] += 1.0 - u[j] / mu[j]
                info[b, a] += 1.0 - u[j] / mu[j]
    # N = sum over pools of (1 + beta) * (sum_j theta + psi); psi is independent with variance psi
    cov = np.linalg.inv(info)
    grad = np.zeros(size)
    for (g, _), k in at.items():
        grad[k] = 1.0 + beta[g]
    grad[len(free):] = released
    never = released - m.sum(axis=1)
    n_hat = float(((1.0 + beta) * released).sum())
    return float(grad @ cov @ grad + ((1.0 + beta) ** 2 * np.maximum(never, 0.0)).sum() - n_hat)


def _poisson_log(k, mean):
    k, mean = np.asarray(k, float), np.asarray(mean, float)
    gamma = np.array([math.lgamma(v + 1.0) for v in k.ravel()]).reshape(k.shape)
    return np.where(mean > 0, k * np.log(np.where(mean > 0, mean, 1.0)) - mean - gamma, 0.0).sum()


def join_empty_weeks(marked, u):
    """Join each week without marked recoveries to the last week before it that has some (or the
    first after it): its unmarked catch says nothing about a capture rate of its own. The fit reports
    how many weeks were joined (``merged_weeks``)."""
    filled = np.flatnonzero(marked.sum(axis=0) > 0)
    if len(filled) == 0:
        return marked, u
    spot = np.maximum(np.searchsorted(filled, np.arange(len(u)), side="right") - 1, 0)
    return marked[:, filled], np.bincount(spot, weights=u, minlength=len(filled))


def _season_arrays(cells: pd.DataFrame):
    """Recoveries by (row, week), never seen again by row, unmarked by week, and the rows' pools as 0/1 rows with their names."""
    rows = sorted(cells.loc[cells["kind"].isin(["recovered", "never"]), "row"].unique())
    cols = sorted(cells.loc[cells["kind"].isin(["recovered", "unmarked"]), "col"].unique())
    row_at, col_at = {r: i for i, r in enumerate(rows)}, {c: j for j, c in enumerate(cols)}
    marked, never, u = np.zeros((len(rows), len(cols))), np.zeros(len(rows)), np.zeros(len(cols))
    pool_of: dict = {}
    for kind, row, column, pool, n in cells[["kind", "row", "col", "pool", "n"]].itertuples(index=False):
        if kind == "unmarked":
            u[col_at[column]] += n
            continue
        pool_of[row_at[row]] = pool
        if kind == "recovered":
            marked[row_at[row], col_at[column]] += n
        else:
            never[row_at[row]] += n
    labels = sorted(set(pool_of.values()))
    member = np.array([[pool_of[i] == g for i in range(len(rows))] for g in labels], dtype=float).reshape(len(labels), len(rows))
    return marked, never, u, member, labels


def pooled_counts(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recoveries by (pool, week), unmarked by week and releases by pool of one group's cells."""
    marked, never, u, member, _ = _season_arrays(cells)
    return member @ marked, u, member @ (marked.sum(axis=1) + never)


def fit_season(cells: pd.DataFrame) -> dict:
    """Fit one matrix given as rows ``(kind, row, col, pool, n)``.

    No fit is given when a pool has no recaptures, no standard error when a pool is fully caught
    (``boundary``). ``overdrawn_rows`` counts weeks with more recoveries than releases, which no
    closed population can produce; their "never seen" cell enters the likelihood as zero.
    """
    marked, never, u, member, labels = _season_arrays(cells)
    n_weeks = len(u)
    marked, u = join_empty_weeks(marked, u)
    m = member @ marked
    released = member @ (marked.sum(axis=1) + never)
    usable = bool((m.sum(axis=1) > 0).all()) and u.sum() > 0 and len(never) > 0
    out = dict(
        n_rows=len(never), n_cols=len(u), n_pools=len(labels), merged_weeks=n_weeks - len(u), pools=[str(g) for g in labels],
        log_lik=None, np=None, aicc=None, gof_chisq=None, gof_df=None, gof_p=None, n_hat=None, n_hat_se=None,
        boundary=None, converged=False, overdrawn_rows=int((never < 0).sum()), capture_p=None,
    )
    if not usable:
        return out
    beta, theta, converged = fit_pools(m, u)
    out.update(np=int((marked > 0).sum() + len(never) + len(labels)), gof_df=int((u > 0).sum() - len(labels)))
    if not converged:  # no estimate and no criterion from a fit that has not arrived
        return out
    boundary = bool((beta < 1e-6).any())
    n_hat = float(((1.0 + beta) * released).sum())
    variance = math.nan
    if converged and not boundary:
        try:
            variance = _abundance_variance(beta, theta, m, u, released)
        except np.linalg.LinAlgError:
            pass
    # within a pool the fitted row cells keep the proportions of the observed ones
    own = member.T @ np.divide(theta, m, out=np.zeros_like(m), where=m > 0)
    fitted = marked * own
    mu = (beta[:, None] * theta).sum(axis=0)
    log_lik = _poisson_log(marked, fitted) + _poisson_log(np.maximum(never, 0.0), never) + _poisson_log(u, mu)
    params, df = out["np"], out["gof_df"]
    n_all = float(marked.sum() + never.sum() + u.sum())
    chisq = float(
        np.divide((marked - fitted) ** 2, fitted, out=np.zeros_like(fitted), where=fitted > 0).sum()
        + np.divide((u - mu) ** 2, mu, out=np.zeros_like(mu), where=mu > 0).sum()
    )
    spare = n_all - params - 1
    out.update(
        log_lik=float(log_lik),
        aicc=float(-2 * log_lik + 2 * params + 2 * params * (params + 1) / spare) if spare > 0 else None,
        gof_chisq=chisq, gof_p=chi_square_tail(chisq, df) if df > 0 else None,
        n_hat=n_hat, n_hat_se=math.sqrt(variance) if variance > 0 else None,
        boundary=boundary, converged=converged, capture_p=[float(p) for p in 1.0 / (1.0 + beta)],
    )
    return out


def candidate_models(
    matrix: DataFrame, models: dict[str, DataFrame | str], keys: Sequence[str] = ()
) -> DataFrame:
    """Stack one copy of the (weekly) matrix per model with its row pools.

    A model is ``"single"`` (one pool), ``"full"`` (every row its own) or a table
    ``(keys, stratum, pool)``.
    """
    keys = list(keys)
    base = matrix.where(F.col("kind") != "unassigned").select(
        *keys, "kind", F.col("release_week").cast("string").alias("row"),
        F.col("recover_week").cast("string").alias("col"), F.col("n").cast("double").alias("n"),
    )
    out = None
    for model_id, pools in models.items():
        if isinstance(pools, str):
            pool = F.lit("all") if pools == "single" else F.col("row")
            one = base.withColumn("pool", F.when(F.col("row").isNotNull(), pool))
        else:
            names = pools.select(
                *keys, F.col("stratum").cast("string").alias("row"), F.col("pool").cast("string").alias("pool")
            )
            one = left_join(base, names, [*keys, "row"])
        one = one.withColumn("model_id", F.lit(model_id))
        out = one if out is None else out.unionByName(one)
    return out


def fit_models(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per season and model, fitted in parallel over the groups.

    The cells are few but the fits are not free, so they are spread over a fixed number of
    partitions: sized by bytes, they would all end up in one task.
    """
    by = [*keys, "model_id"]
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", " + FIT_COLUMNS
    order = [*by, *[part.split()[0] for part in FIT_COLUMNS.split(", ")]]

    def fit(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        found = {**dict(zip(by, group)), **fit_season(pdf)}
        return pd.DataFrame([[found[name] for name in order]], columns=order)

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, *by).groupBy(*by).applyInPandas(fit, schema)
