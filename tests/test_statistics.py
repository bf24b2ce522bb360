"""Quantiles, regressions, smoother, tails: against NumPy, plain Python and Spark ML."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tallyweir.functions.distributions import chi_square_tail, student_two_sided
from tallyweir.operators import aggregates, biology, histograms, regression


@pytest.mark.parametrize("kind", ["mixed", "ties", "tiny", "narrow", "zeros"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(3)
    data = {
        "mixed": np.concatenate([rng.normal(0, 1e3, 400), rng.normal(0, 1e-6, 101), [0.0, 1e200, -1e200]]),
        "ties": rng.integers(1, 5, 300).astype(float),
        "tiny": np.array([3.0, -7.5]),
        "narrow": 1e9 + rng.random(500) * 1e-3,
        "zeros": np.array([0.0, 0.0, 0.0, -1.0]),
    }[kind]
    rows = [(kind, float(v)) for v in data] + [("other", 4.0), ("gap", None), ("gap", float("nan"))]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    out = {r.k: r for r in aggregates.exact_quantiles(df, "v", probs, ["k"]).collect()}
    assert set(out) == {kind, "other"}
    assert out[kind].n == len(data)
    expected = np.quantile(data, probs)
    got = [out[kind][f"q{i}"] for i in range(len(probs))]
    assert np.allclose(got, expected, rtol=1e-12, atol=0 if kind == "narrow" else 1e-12)
    assert [out["other"][f"q{i}"] for i in range(len(probs))] == [4.0] * len(probs)


def test_quantiles_without_keys_and_summary(spark):
    data = np.random.default_rng(4).gamma(2.0, 3.0, 777)
    df = spark.createDataFrame([(float(v),) for v in data], "v DOUBLE")
    row = biology.distribution_summary(df, "v").first()
    assert row.n == 777
    assert np.allclose(
        [row["mean"], row.sd, row["min"], row.q1, row.median, row.q3, row["max"]],
        [data.mean(), data.std(ddof=1), data.min(), *np.quantile(data, [0.25, 0.5, 0.75]), data.max()],
    )


def test_box_summary(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 5, 100)] + [("b", 7.0)]
    out = {r.k: r for r in histograms.box_summary(spark.createDataFrame(rows, "k STRING, v DOUBLE"), "v", ["k"]).collect()}
    assert (out["a"].lower, out["a"].middle, out["a"].upper) == (2.25, 3.5, 4.75)
    assert (out["a"].whisker_low, out["a"].whisker_high, out["a"].n_outliers) == (1.0, 5.0, 1)
    assert (out["b"].whisker_low, out["b"].whisker_high, out["b"].n_outliers) == (7.0, 7.0, 0)


def test_line_fit_against_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.random(60) * 9 + 1
    y = 2 - 0.7 * x + rng.normal(0, 0.3, 60)
    fit = regression.line_fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x DOUBLE, y DOUBLE"), "x", "y").first()
    design = np.column_stack([np.ones(60), x])
    coef, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    cov = rss[0] / 58 * np.linalg.inv(design.T @ design)
    assert np.allclose([fit.intercept, fit.slope], coef)
    assert np.allclose([fit.se_intercept, fit.se_slope], np.sqrt(np.diag(cov)))
    band = regression.line_band(spark.createDataFrame([fit.asDict()]), F.lit(4.0)).first()
    at = np.array([1.0, 4.0])
    assert np.allclose([band.fitted, band.se_fitted], [at @ coef, math.sqrt(at @ cov @ at)])


def test_factor_fit_against_spark_ml(spark):
    rng = np.random.default_rng(6)
    rows = []
    for level, shift in (("barn", 0.0), ("fence", -0.4), ("weir", 1.1)):
        rows += [(level, float(d), float(5 + 0.06 * d + shift + rng.normal(0, 0.5))) for d in rng.integers(100, 180, 40)]
    df = spark.createDataFrame(rows, "site STRING, day DOUBLE, temp DOUBLE")
    mine = {r.term: r for r in regression.factor_line_fit(df, "day", "temp", "site").collect()}
    ready = RFormula(formula="temp ~ day + site", stringIndexerOrderType="alphabetDesc").fit(df).transform(df)
    model = LinearRegression(solver="normal").fit(ready)
    names = [a["name"] for a in sorted(
        sum(ready.schema["features"].metadata["ml_attr"]["attrs"].values(), []), key=lambda a: a["idx"])]
    order = ["slope" if n == "day" else "site=" + n.split("_")[1] for n in names] + ["intercept"]
    s = model.summary
    assert np.allclose([mine[t].estimate for t in order], [*model.coefficients, model.intercept])
    assert np.allclose([mine[t].std_error for t in order], s.coefficientStandardErrors)
    assert np.allclose([mine[t].p_value for t in order], s.pValues, atol=1e-10)


def test_smoother_against_direct_weighting(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(100, 140, 150).astype(float)
    y = np.sin(x / 9) + rng.normal(0, 0.1, 150)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x DOUBLE, y DOUBLE")
    out = sorted((r.x, r.smooth) for r in regression.local_smoother(df, "x", "y", grid=9).collect())
    q = math.floor(150 * 0.75 + 1e-5)
    for at, value in out:
        d = np.abs(x - at)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        design = np.column_stack([np.ones_like(x), x - at, (x - at) ** 2])
        expected = np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (w * y))[0]
        assert value == pytest.approx(expected, rel=1e-8)


def test_tail_probabilities():
    # closed forms: chi-square with 2 df is exponential; Student with 1 df is Cauchy, with 2 df algebraic
    for x in (0.1, 1.0, 4.6, 30.0):
        assert chi_square_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert chi_square_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
        assert student_two_sided(x, 1) == pytest.approx(1 - 2 * math.atan(x) / math.pi, rel=1e-10)
        assert student_two_sided(x, 2) == pytest.approx(1 - x / math.sqrt(2 + x * x), rel=1e-10)
    assert chi_square_tail(0.0, 3) == 1.0 and math.isnan(chi_square_tail(1.0, 0))


def test_thirty_bins_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v DOUBLE")
    assert [(r.bin_no, r.n) for r in histograms.fixed_count(df, "v").collect()] == [(0, 2)]
