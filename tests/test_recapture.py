"""Estimators, matrix, pooling and stratified fits: goldens, brute force, identities."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.operators import accounting, recapture, scenarios, stratified
from tallyweir.plans import estimates, fence
from tests.goldens import POOLS, SEASON_A, SEASON_B, matrix_rows

WEEK = dt.timedelta(weeks=1)
MONDAY = dt.date(2024, 5, 6)


@pytest.fixture(scope="module")
def matrix(spark):
    rows = matrix_rows(SEASON_A, "A") + matrix_rows(SEASON_B, "B")
    return spark.createDataFrame(rows, "season STRING, release_week DATE, recover_week DATE, kind STRING, n DOUBLE").withColumn(
        "ambiguous", F.lit(False))


def test_closed_population_formulas(spark):
    df = spark.createDataFrame([(5544.0, 12506.0, 2139.0), (10.0, 8.0, 0.0)], "m DOUBLE, c DOUBLE, r DOUBLE")
    a, b = recapture.with_abundance(df, "m", "c", "r").orderBy(F.desc("m")).collect()
    assert a.lincoln_petersen == pytest.approx(5544 * 12506 / 2139)
    assert a.chapman == pytest.approx(32406.2, abs=0.05) and a.std_error == pytest.approx(499.7, abs=0.05)
    assert a.upper_95 - a.lower_95 == pytest.approx(2 * 1.96 * a.std_error)
    assert b.lincoln_petersen is None and b.chapman == 98.0


def test_margins_of_the_published_tables(matrix):
    out = {
        r.season: (r.marked, r.recaps, r.caught) for r in matrix.groupBy("season").agg(
            F.sum(F.when(F.col("kind").isin("recovered", "never"), F.col("n"))).alias("marked"),
            F.sum(F.when(F.col("kind") == "recovered", F.col("n"))).alias("recaps"),
            F.sum(F.when(F.col("kind").isin("recovered", "unmarked"), F.col("n"))).alias("caught"),
        ).collect()
    }
    assert out == {"A": (5544.0, 2139.0, 12506.0), "B": (5136.0, 1253.0, 13873.0)}


def test_stratified_fits_match_published_estimate(matrix):
    fits = {(r.season, r.model_id): r for r in estimates.candidate_fits(matrix, ["season"]).collect()}
    single, full, auto = (estimates.MODEL_NAMES[k] for k in ("single", "full", "auto"))
    assert round(fits["A", auto].n_hat) == 35717 and round(fits["A", auto].n_hat_se) == 1317
    assert fits["A", single].n_hat == pytest.approx(5544 * 12506 / 2139, rel=1e-6)
    assert fits["A", full].n_hat == pytest.approx(36435.0, abs=0.5)
    assert fits["A", auto].aicc < fits["A", full].aicc < fits["A", single].aicc
    # season B: one week is fully caught, so there is an estimate but no standard error
    assert fits["B", auto].boundary and fits["B", auto].n_hat_se is None
    assert fits["B", auto].n_hat == pytest.approx(55976.0, abs=0.5)
    assert fits["B", full].n_hat == pytest.approx(57468.9, abs=0.5)
    report = estimates.model_report(estimates.candidate_fits(matrix, ["season"]), ["season"])
    best = {r.season: r for r in estimates.best_model(report).collect()}
    assert best["A"].model_id == auto and best["A"].delta_aicc == 0.0 and best["A"].n_hat == 35717.0


def test_automatic_pools_join_the_two_ends(matrix):
    strata = recapture.stratum_totals(matrix.where("season = 'A'"), ["season"])
    pools = recapture.auto_pool(strata, estimates.POOL_MINIMUM, ["season"])
    got = [((r.pool - MONDAY).days // 7) for r in pools.orderBy("stratum").collect()]
    first = [POOLS.index(p) for p in POOLS]
    assert got == first


def test_automatic_pools_when_all_is_small(spark):
    df = spark.createDataFrame([(i, 3.0) for i in range(1, 5)], "stratum INT, released DOUBLE")
    assert {r.pool for r in recapture.auto_pool(df, {"released": 100.0}).collect()} == {1}


def test_pooled_matrix_keeps_totals(matrix, spark):
    pools = recapture.auto_pool(recapture.stratum_totals(matrix, ["season"]), estimates.POOL_MINIMUM, ["season"])
    columns = recapture.auto_pool(recapture.inspected_totals(matrix, ["season"]), {"inspected": 300.0}, ["season"])
    out = recapture.pool_matrix(matrix, pools, columns, ["season"])
    assert out.agg(F.sum("n")).first()[0] == matrix.agg(F.sum("n")).first()[0]
    assert out.where("season = 'A' AND kind = 'unmarked'").count() < 8


def _weekly(spark, rows):
    return spark.createDataFrame([(MONDAY + w * WEEK, m, float(n)) for w, m, n in rows], "week DATE, mark STRING, n DOUBLE")


def test_matrix_is_built_from_alternating_marks(spark):
    """The published table, rebuilt from weekly totals per mark."""
    marks = ["top", "bottom"]
    releases = [(i, marks[i % 2], sum(SEASON_A[i])) for i in range(8)]
    seen = [(j, marks[j % 2], SEASON_A[j][j]) for j in range(8)]
    seen += [(j, marks[(j - 1) % 2], SEASON_A[j - 1][j]) for j in range(1, 8)]
    unmarked = spark.createDataFrame([(MONDAY + j * WEEK, float(SEASON_A[8][j])) for j in range(8)], "week DATE, n DOUBLE")
    out = recapture.release_recovery_matrix(_weekly(spark, releases), _weekly(spark, seen), unmarked)
    got = {("s", r.release_week, r.recover_week, r.kind, r.n) for r in out.collect()}
    assert got == set(matrix_rows(SEASON_A, "s"))


def test_matrix_splits_ambiguous_and_keeps_unassigned(spark):
    releases = _weekly(spark, [(0, "top", 30), (1, "top", 10), (1, "bottom", 5)])
    seen = _weekly(spark, [(1, "top", 8), (2, "bottom", 2), (5, "top", 3)])
    unmarked = spark.createDataFrame([(MONDAY, 4.0)], "week DATE, n DOUBLE")
    cells = {
        (r.kind, r.release_week and (r.release_week - MONDAY).days // 7, r.recover_week and (r.recover_week - MONDAY).days // 7): (r.n, r.ambiguous)
        for r in recapture.release_recovery_matrix(releases, seen, unmarked).collect()
    }
    assert cells == {
        ("recovered", 0, 1): (6.0, True), ("recovered", 1, 1): (2.0, True), ("recovered", 1, 2): (2.0, False),
        ("unassigned", None, 5): (3.0, False), ("never", 0, None): (24.0, False), ("never", 1, None): (11.0, False),
        ("unmarked", None, 0): (4.0, False),
    }


def test_fit_is_a_maximum():
    """No small move of the fitted values raises the likelihood."""
    m = np.array([[8.0, 2, 0], [0, 4, 14], [0, 0, 60]])
    u = np.array([157.0, 82, 782])
    member = np.array([[1.0, 1, 0], [0, 0, 1]])
    beta, theta, converged = stratified.fit_pools(member @ m, u)
    top = stratified._log_lik(beta, theta, member @ m, u)
    rng = np.random.default_rng(1)
    for _ in range(200):
        b = beta * np.exp(rng.normal(0, 0.02, 2))
        th = theta * np.exp(rng.normal(0, 0.02, theta.shape))
        assert stratified._log_lik(b, th, member @ m, u) <= top + 1e-9
    assert converged


def test_standard_error_agrees_with_repeated_sampling():
    """Closed population of known size: the spread of the estimates matches the reported errors."""
    import pandas as pd

    rng = np.random.default_rng(11)
    estimates_, errors = [], []
    for _ in range(150):
        rows = []
        unmarked = np.zeros(3)
        for i, (size, marked, p) in enumerate(((3000, 500, 0.2), (5000, 900, 0.3))):
            for group, is_marked in ((marked, True), (size - marked, False)):
                cells = rng.multinomial(group, [0.6 * p, 0.4 * p, 1 - p])
                if is_marked:
                    rows += [("recovered", i, i, i, cells[0]), ("recovered", i, i + 1, i, cells[1]), ("never", i, None, i, cells[2])]
                else:
                    unmarked[i] += cells[0]
                    unmarked[i + 1] += cells[1]
        rows += [("unmarked", None, j, None, unmarked[j]) for j in range(3)]
        fit = stratified.fit_season(pd.DataFrame(rows, columns=["kind", "row", "col", "pool", "n"]))
        estimates_.append(fit["n_hat"])
        errors.append(fit["n_hat_se"])
    assert np.mean(estimates_) == pytest.approx(8000, rel=0.01)
    assert np.std(estimates_, ddof=1) == pytest.approx(np.mean(errors), rel=0.2)


def test_pool_without_recaptures_has_no_fit():
    import pandas as pd

    rows = [("never", 1, None, 1, 10.0), ("recovered", 2, 2, 2, 5.0), ("never", 2, None, 2, 5.0), ("unmarked", None, 2, None, 9.0)]
    fit = stratified.fit_season(pd.DataFrame(rows, columns=["kind", "row", "col", "pool", "n"]))
    assert fit["n_hat"] is None and fit["converged"] is False


def test_unknown_marks_follow_the_known_ones(spark):
    df = spark.createDataFrame(
        [(18, 6.0, 2.0, 5.0), (19, 6.0, 2.0, 5.0), (20, 0.0, 0.0, 3.0), (21, 1.0, 1.0, 1.0)],
        "iso_week INT, top DOUBLE, bottom DOUBLE, none DOUBLE",
    )
    def run(inclusive):
        out = accounting.reallocate_unknown(df, "top", "bottom", "none", "iso_week", 19, inclusive)
        return {r.iso_week: (r.top, r.bottom, r.none) for r in out.collect()}

    # 5 * 0.75 -> 4, 5 * 0.25 -> 1; no known mark: all go to the second; 0.5 rounds to 0 on both sides
    assert run(True) == {18: (6.0, 2.0, 5.0), 19: (10.0, 3.0, 0.0), 20: (0.0, 3.0, 0.0), 21: (1.0, 1.0, 1.0)}
    assert run(False)[19] == (6.0, 2.0, 5.0)


def test_caps_and_thresholds_around_the_limit(spark):
    rows = [(2020, dt.date(2020, 9, d), n) for d, n in ((1, 19), (2, 20), (3, 21))] + [(2021, dt.date(2021, 12, 1), 30)]
    daily = spark.createDataFrame(rows, "year INT, date DATE, n INT")
    out = {(r.year, r.cap, r.last_day): (r.total, r.tagged) for r in scenarios.capped_tagging(daily, "n", [(20, None), (20, 288)]).collect()}
    assert out == {(2020, 20.0, None): (60.0, 59.0), (2021, 20.0, None): (30.0, 20.0), (2020, 20.0, 288): (60.0, 59.0)}
    over = {(r.year, r.threshold): r.days for r in scenarios.days_over(daily, "n", [20, 25]).collect()}
    assert over == {(2020, 20.0): 2, (2021, 20.0): 1, (2021, 25.0): 1}


def test_season_effort_counts_unknown_checks_once(spark):
    effort = spark.createDataFrame([(2020, dt.date(2020, 9, 1), "am"), (2020, dt.date(2020, 9, 1), "am")], "year INT, date DATE, time_of_day STRING")
    fish = spark.createDataFrame([(2020, dt.date(2020, 9, 1), "am")] * 5 + [(2020, dt.date(2020, 9, 3), "pm")] * 4, "year INT, date DATE, time_of_day STRING")
    row = scenarios.season_effort(effort, fish).first()
    assert (row.days_total, row.checks_total, row.hours_at_1_5, row.hours_at_2) == (2, 3, 4.5, 6.0)


def test_repeat_rules_of_the_fence(spark):
    rows = [("orange", 2022), ("orange", 2023), ("pink", 2020), (None, 2022), ("blue", 2024)]
    df = spark.createDataFrame(rows, "recap_tag_colour STRING, year INT")
    assert {(r[0], r[1]) for r in fence.without_repeats(df).collect()} == {("orange", 2023), (None, 2022), ("blue", 2024)}
