"""Least squares from moments, and a local smoother.

All fits come from one aggregation pass: counts, means, variances and covariances are combined in
the map tasks, so group size does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.distributions import student_p
from tallyweir.functions.missing import col, ratio
from tallyweir.operators.joins import left_join
from tallyweir.session import materialise


def _moments(x: str, y: str) -> list[Column]:
    n = F.count(F.lit(1)).cast("double")
    return [
        n.alias("n"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        (F.var_pop(x) * n).alias("sxx"),
        (F.var_pop(y) * n).alias("syy"),
        (F.covar_pop(x, y) * n).alias("sxy"),
    ]


def _pairs(df: DataFrame, keys: Sequence[str], x: str | Column, y: str | Column) -> DataFrame:
    both = df.select(*keys, col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y"))
    return both.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())


def line_fit(df: DataFrame, x: str | Column, y: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Straight line per group with standard errors, R² and residual SD."""
    rows = _pairs(df, keys, x, y)
    m = (rows.groupBy(*keys) if keys else rows).agg(*_moments("_x", "_y"))
    return (
        m.withColumn("slope", ratio("sxy", "sxx"))
        .withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))
        .withColumn("r2", ratio(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
        .withColumn("_rss", F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)))
        .withColumn("residual_sd", F.sqrt(ratio("_rss", F.when(F.col("n") > 2, F.col("n") - 2))))
        .withColumn("se_slope", ratio("residual_sd", F.sqrt("sxx")))
        .withColumn(
            "se_intercept",
            F.col("residual_sd") * F.sqrt(1 / F.col("n") + ratio(F.col("mean_x") * F.col("mean_x"), "sxx")),
        )
        .drop("_rss")
    )


def line_band(fits: DataFrame, at: Column, name: str = "x") -> DataFrame:
    """Fitted value and its standard error at ``at`` for every fitted line."""
    out = fits.withColumn(name, at)
    away = F.col(name) - F.col("mean_x")
    return out.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col(name)).withColumn(
        "se_fitted", F.col("residual_sd") * F.sqrt(1 / F.col("n") + ratio(away * away, "sxx"))
    )


def factor_line_fit(
    df: DataFrame, x: str | Column, y: str | Column, factor: str, keys: Sequence[str] = (), p_values: bool = True
) -> DataFrame:
    """Coefficient table of a common slope with one level effect per factor value.

    The alphabetically first level is the baseline. The slope comes from within-level moments, the
    effects from level means, so the design matrix is never built.
    """
    keys = list(keys)
    rows = _pairs(df, [*keys, factor], x, y).where(F.col(factor).isNotNull())
    levels = rows.groupBy(*keys, factor).agg(*_moments("_x", "_y"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    base = F.min_by(F.struct("n", "mean_x", "mean_y"), F.col(factor)).over(whole)
    fit = (
        levels.withColumns(
            {
                "_sxx": F.sum("sxx").over(whole), "_sxy": F.sum("sxy").over(whole), "_syy": F.sum("syy").over(whole),
                "_n": F.sum("n").over(whole), "_g": F.count(F.lit(1)).over(whole), "_b": base,
                "_first": F.col(factor) == F.min(factor).over(whole),
            }
        )
        .withColumn("_slope", ratio("_sxy", "_sxx"))
        .withColumn("df", F.col("_n") - F.col("_g") - 1)
        .withColumn("_s2", ratio(F.col("_syy") - F.col("_slope") * F.col("_sxy"), "df"))
        .withColumn("_own", F.col("mean_y") - F.col("_slope") * F.col("mean_x"))
        .withColumn("_base", F.col("_b.mean_y") - F.col("_slope") * F.col("_b.mean_x"))
    )
    shift = F.col("mean_x") - F.col("_b.mean_x")
    slope_row = F.struct(
        F.lit("slope").alias("term"), F.col("_slope").alias("estimate"), F.sqrt(ratio("_s2", "_sxx")).alias("std_error")
    )
    base_row = F.struct(
        F.lit("intercept").alias("term"), F.col("_own").alias("estimate"),
        F.sqrt(F.col("_s2") * (1 / F.col("n") + ratio(F.col("mean_x") * F.col("mean_x"), "_sxx"))).alias("std_error"),
    )
    level_row = F.struct(
        F.concat(F.lit(f"{factor}="), F.col(factor).cast("string")).alias("term"),
        (F.col("_own") - F.col("_base")).alias("estimate"),
        F.sqrt(
            F.col("_s2") * (1 / F.col("n") + 1 / F.col("_b.n") + ratio(shift * shift, "_sxx"))
        ).alias("std_error"),
    )
    terms = F.when(F.col("_first"), F.array(base_row, slope_row)).otherwise(F.array(level_row))
    out = (
        fit.select(*keys, "df", F.explode(terms).alias("_t")).select(*keys, "_t.*", "df")
        .withColumn("t_value", ratio("estimate", "std_error"))
    )
    return out.withColumn("p_value", student_p("t_value", "df")) if p_values else out


def power_law(length: str | Column, intercept: Column, slope: Column) -> Column:
    """Prediction of a line fitted on log10 scales, back on the natural scale."""
    return F.pow(F.lit(10.0), intercept + slope * F.log10(col(length)))


def local_smoother(
    df: DataFrame,
    x: str | Column,
    y: str | Column,
    keys: Sequence[str] = (),
    unit: float = 1.0,
    span: float = 0.75,
    grid: int = 80,
) -> DataFrame:
    """Locally quadratic, tricube-weighted curve on an even grid.

    Weights depend on x only, so the data are first reduced to moments per x cell of width
    ``unit`` (exact for daily series with unit 1, otherwise x is rounded to the cell centre). The
    bandwidth at a grid point reaches the nearest ``span`` share of the observations.
    """
    keys = list(keys)
    by = keys or [F.lit(0)]
    cell = F.round(F.col("_x") / F.lit(float(unit))) * F.lit(float(unit))
    cells = (
        _pairs(df, keys, x, y).groupBy(*keys, cell.alias("_x"))
        .agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_y").alias("_sy"))
    )
    group = Window.partitionBy(*by)
    spread = cells.withColumns(
        {"_lo": F.min("_x").over(group), "_hi": F.max("_x").over(group), "_all": F.sum("_n").over(group)}
    )
    # every cell meets each of the fixed number of grid points
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / float(max(grid - 1, 1))
    points = (
        spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_i"))
        .withColumn("x", at).withColumn("_d", F.abs(F.col("_x") - F.col("x")))
    )
    near = Window.partitionBy(*by, "_i").orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    point = Window.partitionBy(*by, "_i")
    needed = F.floor(F.col("_all") * F.lit(float(span)) + 1e-5)
    reach = F.min(F.when(F.col("_seen") >= needed, F.col("_d"))).over(point)
    weighted = (
        points.withColumn("_seen", F.sum("_n").over(near)).withColumn("_h", reach)
        .where(F.col("_d") < F.col("_h"))
        .withColumn("_u", ratio("_d", "_h"))
        .withColumn("_w", F.pow(1 - F.pow(F.col("_u"), F.lit(3.0)), F.lit(3.0)))
        .withColumn("_c", F.col("_x") - F.col("x"))
    )
    w, c, n, sy = (F.col(k) for k in ("_w", "_c", "_n", "_sy"))
    sums = [F.sum(w * n * F.pow(c, F.lit(float(k)))).alias(f"m{k}") for k in range(5)]
    sums += [F.sum(w * sy * F.pow(c, F.lit(float(k)))).alias(f"b{k}") for k in range(3)]
    fit = weighted.groupBy(*keys, "_i", "x").agg(*sums)
    m0, m1, m2, m3, m4, b0, b1, b2 = (F.col(k) for k in ("m0", "m1", "m2", "m3", "m4", "b0", "b1", "b2"))
    # value at the grid point = constant term of the 3 x 3 normal equations (Cramer's rule)
    det = m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2)
    top = b0 * (m2 * m4 - m3 * m3) - m1 * (b1 * m4 - b2 * m3) + m2 * (b1 * m3 - b2 * m2)
    return fit.select(*keys, "x", ratio(top, det).alias("smooth"))


def local_band(
    df: DataFrame, x: str | Column, y: str | Column, keys: Sequence[str] = (), unit: float = 1.0, span: float = 0.75, grid: int = 80
) -> DataFrame:
    """:func:`local_smoother` with its standard error: keys, x, smooth, se, residual_sd, parameters, residual_df.

    The fit at a point is a weighted sum of the observations; the weights follow from the moments of the x cells, and
    all observations of a cell have the same. With L the matrix of these weights at the observations themselves,
    ``parameters`` is its trace, ``residual_df`` is n - 2 tr L + tr LL', the residual variance the residual sum of squares
    over that, and ``se`` the root of the variance times the sum of squared weights at the point. Observations are read once;
    what is fitted are the cells of a season (days), at the grid and at the cells.
    """
    keys = list(keys)
    cell = F.round(F.col("_x") / F.lit(float(unit))) * F.lit(float(unit))
    sums = [F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_y").alias("_sy"), F.sum(F.col("_y") * F.col("_y")).alias("_syy")]
    cells = materialise(_pairs(df, keys, x, y).groupBy(*keys, cell.alias("_x")).agg(*sums))
    bounds = cells.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_all"))
    step = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_i")
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / float(max(grid - 1, 1))
    even = bounds.select(*keys, step, "_lo", "_hi").select(*keys, F.lit(True).alias("_even"), at.alias("x"))
    own = cells.select(*keys, F.lit(False).alias("_even"), F.col("_x").alias("x"))
    named = {k: f"_p{j}" for j, k in enumerate(keys)}
    points = left_join(even.unionByName(own), bounds.select(*keys, "_all"), keys) if keys else even.unionByName(own).join(F.broadcast(bounds.select("_all")))
    same = F.lit(True)
    for k, other in named.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    pairs = points.join(cells.withColumnsRenamed(named), same).drop(*named.values()).withColumn("_d", F.abs(F.col("_x") - F.col("x")))
    point = Window.partitionBy(*keys, "_even", "x")
    seen = F.sum("_n").over(point.orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    needed = F.floor(F.col("_all") * F.lit(float(span)) + 1e-5)
    reach = F.min(F.when(F.col("_seen") >= needed, F.col("_d"))).over(point)
    near = (
        pairs.withColumn("_seen", seen).withColumn("_h", reach).where(F.col("_d") < F.col("_h"))
        .withColumn("_w", F.pow(1 - F.pow(ratio("_d", "_h"), F.lit(3.0)), F.lit(3.0))).withColumn("_c", F.col("_x") - F.col("x"))
    )
    w, c, n = F.col("_w"), F.col("_c"), F.col("_n")
    near = near.withColumns({f"m{k}": F.sum(w * n * F.pow(c, F.lit(float(k)))).over(point) for k in range(5)})
    m0, m1, m2, m3, m4 = (F.col(f"m{k}") for k in range(5))
    minors = (m2 * m4 - m3 * m3, m1 * m4 - m2 * m3, m1 * m3 - m2 * m2)
    det = m0 * minors[0] - m1 * minors[1] + m2 * minors[2]
    # the weight of one observation of the cell: the first row of the inverse normal equations times (1, c, c * c)
    near = near.withColumn("_l", w * ratio(minors[0] - minors[1] * c + minors[2] * c * c, det))
    leverage = F.sum(F.when(F.col("_x") == F.col("x"), F.col("_l")))
    fits = materialise(near.groupBy(*keys, "_even", "x").agg(
        F.sum(F.col("_l") * F.col("_sy")).alias("smooth"), F.sum(n * F.col("_l") * F.col("_l")).alias("_norm"), leverage.alias("_own")))
    at_cells = left_join(fits.where("NOT _even"), cells.withColumnRenamed("_x", "x"), [*keys, "x"])
    rss = F.sum(F.col("_syy") - 2 * F.col("smooth") * F.col("_sy") + n * F.col("smooth") * F.col("smooth"))
    season = at_cells.groupBy(*keys).agg(
        F.greatest(rss, F.lit(0.0)).alias("_rss"), F.sum(n).alias("_total"), F.sum(n * F.col("_own")).alias("parameters"), F.sum(n * F.col("_norm")).alias("_square"))
    season = season.withColumn("residual_df", F.col("_total") - 2 * F.col("parameters") + F.col("_square"))
    season = season.withColumn("residual_sd", F.sqrt(ratio("_rss", F.when(F.col("residual_df") > 0, F.col("residual_df")))))
    curve = fits.where("_even")
    shown = [*keys, "residual_sd", "parameters", "residual_df"]
    out = left_join(curve, season.select(*shown), keys) if keys else curve.join(F.broadcast(season.select(*shown)))
    return out.select(*keys, "x", "smooth", (F.col("residual_sd") * F.sqrt("_norm")).alias("se"), "residual_sd", "parameters", "residual_df")
