"""The fixed-point fits against the Newton fits and closed forms; bootstrap limits against known populations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.operators import bootstrap, fixed_point, stratified
from tallyweir.plans import estimates
from tests.goldens import SEASON_A, SEASON_B, matrix_rows

CELLS = "season STRING, model_id STRING, kind STRING, row STRING, col STRING, pool STRING, n DOUBLE"


def random_cells(season, seed, rows=6, pools=3, gap=False):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        pool = f"p{i * pools // rows}"
        released = int(rng.integers(150, 400))
        for j in (i, i + 1):
            if not (gap and j == 3):
                out.append((season, "m", "recovered", f"{i}", f"{j}", pool, float(rng.integers(5, 60))))
        seen = sum(r[-1] for r in out if r[2] == "recovered" and r[3] == f"{i}")
        out.append((season, "m", "never", f"{i}", None, pool, released - seen))
    return out + [(season, "m", "unmarked", None, f"{j}", None, float(rng.integers(40, 300))) for j in range(rows + 1)]


def test_fixed_point_equals_newton(spark):
    rows = [r for k in range(6) for r in random_cells(f"s{k}", k, gap=k % 2 == 1)]
    cells = spark.createDataFrame(rows, CELLS)
    newton = {r.season: r for r in stratified.fit_models(cells, ["season"]).collect()}
    fits = {r.season: r for r in fixed_point.fixed_point_fits(cells, ["season"], rounds=400).collect()}
    assert set(fits) == set(newton)
    inside = [s for s, r in newton.items() if r.converged and not r.boundary]
    assert len(inside) >= 3 and any(newton[s].merged_weeks for s in newton)
    for s in inside:
        assert fits[s].still and fits[s].pools == newton[s].pools
        assert fits[s].n_hat == pytest.approx(newton[s].n_hat, rel=1e-7)
        assert fits[s].capture_p == pytest.approx(newton[s].capture_p, rel=1e-6)


def test_fixed_point_of_the_published_table(spark):
    rows = matrix_rows(SEASON_A, "A") + matrix_rows(SEASON_B, "B")
    matrix = spark.createDataFrame(rows, "season STRING, release_week DATE, recover_week DATE, kind STRING, n DOUBLE").withColumn("ambiguous", F.lit(False))
    fits = {(r.season, r.model_id): r for r in fixed_point.fixed_point_fits(estimates.candidate_cells(matrix, ["season"]), ["season"]).collect()}
    single, auto = estimates.MODEL_NAMES["single"], estimates.MODEL_NAMES["auto"]
    assert round(fits["A", auto].n_hat) == 35717 and fits["A", auto].still
    assert fits["A", single].n_hat == pytest.approx(5544 * 12506 / 2139, rel=1e-9)
    assert not fits["B", auto].still or max(fits["B", auto].capture_p) > 1 - 1e-6  # one week is fully caught


def test_fits_without_data_have_no_estimate(spark):
    rows = [r for r in random_cells("a", 1) if r[2] != "unmarked"] + [r for r in random_cells("b", 2) if not (r[2] == "recovered" and r[5] == "p0")]
    fits = fixed_point.fixed_point_fits(spark.createDataFrame(rows, CELLS), ["season"]).collect()
    assert [(r.n_hat, r.still) for r in fits] == [(None, False)] * 2
    assert fixed_point.fixed_point_fits(spark.createDataFrame([], CELLS), ["season"]).count() == 0


def simulated(spark, seasons, seed, size, p, seen):
    """Closed populations with capture rates ``p`` by pool; the last pool may be fully caught."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(seasons):
        unmarked = np.zeros(len(p))
        for i, rate in enumerate(p):
            marked = rng.binomial(size, rate)
            chances = [seen if j in (i, i - 1) else 0.0 for j in range(len(p))]
            chances.append(1 - sum(chances))
            found = rng.multinomial(marked, chances)
            unmarked += rng.multinomial(size - marked, chances)[:-1]
            rows += [(f"{s}", "m", "recovered", f"{i}", f"{j}", f"{i}", float(n)) for j, n in enumerate(found[:-1]) if n]
            rows.append((f"{s}", "m", "never", f"{i}", None, f"{i}", float(found[-1])))
        rows += [(f"{s}", "m", "unmarked", None, f"{j}", None, float(n)) for j, n in enumerate(unmarked)]
    return spark.createDataFrame(rows, CELLS)


@pytest.mark.parametrize("p", [(0.4, 0.5, 1.0), (0.4, 0.5, 0.6)])
def test_bootstrap_limits_hold_the_population(spark, p):
    size, seasons = 400, 40
    cells = simulated(spark, seasons, 11, size, p, 0.3)
    rows = bootstrap.abundance_intervals(cells, ["season"], replicates=100).collect()
    assert len(rows) == seasons
    held = sum(r.lower <= size * len(p) <= r.upper for r in rows if r.refitted > 50)
    assert held >= 0.8 * sum(r.refitted > 50 for r in rows) and sum(r.refitted > 50 for r in rows) > 0.8 * seasons
    if p[-1] == 1.0:
        assert all(r.boundary for r in rows)
        return
    ses = [r.n_hat_se for r in stratified.fit_models(cells, ["season"]).collect() if r.n_hat_se]
    inner = [r.spread for r in rows if not r.boundary]
    assert np.median(inner) == pytest.approx(np.median(ses), rel=0.3)


def test_bootstrap_repeats_and_ignores_the_layout(spark):
    cells = simulated(spark, 3, 4, 300, (0.4, 0.7), 0.3)
    a, b = (sorted(map(str, bootstrap.abundance_intervals(c, ["season"], replicates=25).collect())) for c in (cells, cells.repartition(5).orderBy("n")))
    assert a == b
    other = bootstrap.abundance_intervals(cells, ["season"], replicates=25, seed=2).collect()
    assert sorted(map(str, other)) != a
    lone = cells.where("kind <> 'unmarked'")
    assert {(r.n_hat, r.lower, r.refitted) for r in bootstrap.abundance_intervals(lone, ["season"], replicates=25).collect()} == {(None, None, 0)}


def test_single_pool_is_the_closed_form(spark):
    cells = simulated(spark, 1, 8, 500, (0.5, 0.5), 0.3).withColumn("pool", F.when(F.col("pool").isNotNull(), F.lit("all")))
    m, r, c = cells.agg(
        F.sum(F.when(F.col("kind").isin("recovered", "never"), F.col("n"))), F.sum(F.when(F.col("kind") == "recovered", F.col("n"))),
        F.sum(F.when(F.col("kind").isin("recovered", "unmarked"), F.col("n"))),
    ).first()
    assert fixed_point.fixed_point_fits(cells, ["season"]).first().n_hat == pytest.approx(m * c / r)
