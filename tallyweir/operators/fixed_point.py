"""The stratified closed-population model as the fixed point of its EM step, with array expressions only.

With w(g, j) the unmarked animals of week j that belong to pool g, M the recoveries of the pool and u the unmarked
catch, the EM step in pooled sufficient statistics is

    x(g, j) = W(g) / (W(g) + M(g)) * (M(g, j) + w(g, j)),    w(g, j) <- u(j) * x(g, j) / sum of x(., j),

with W(g) and M(g) the sums over the pool's weeks. The odds against capture are W(g) / M(g). Two plain steps give a direction
and its change, and an extrapolated step follows them; where that would leave the positive numbers, the plain steps stand.
Every group goes on until it stands still, or for a stated number of rounds: a rate on the boundary is approached
ever more slowly and is reported as not ``still``.

A group's cells are the weeks of a season times the weeks an animal needs to come down, so they fit in one row; all
groups are solved beside each other, and the observation table has been aggregated before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 60
TOLERANCE = 1e-11


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _grouped_sum(values: Column, members: Column) -> Column:
    """Sums of the values at the places that each entry of ``members`` lists."""
    return F.transform(members, lambda places: _sum(F.transform(places, lambda i: F.get(values, i))))


def _em_step(w: Column, pool: Column, week: Column, m: Column, u: Column, m_pool: Column, in_pool: Column, in_week: Column) -> Column:
    def of_sums(total: Column) -> Column:
        def share(i: Column) -> Column:
            g = F.get(pool, i)
            return F.get(total, g) / (F.get(total, g) + F.get(m_pool, g))

        x = F.transform(w, lambda value, i: share(i) * (F.get(m, i) + value))

        def of_x(x: Column) -> Column:
            by_week = _grouped_sum(x, in_week)
            return _let(by_week, lambda s: F.transform(x, lambda value, i: F.when(F.get(s, F.get(week, i)) > 0, F.get(u, F.get(week, i)) * value / F.get(s, F.get(week, i))).otherwise(F.lit(0.0))))

        return _let(x, of_x)

    return _let(_grouped_sum(w, in_pool), of_sums)


def _norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def season_rows(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group: pools, released and recovered per pool, the cells (pool, week, m) as arrays, unmarked per week.

    Weeks without marked recoveries are joined to the last week before them that has some, or to the first one.
    """
    by = [*keys, "model_id"]
    sums = cells.groupBy(*by, "kind", "pool", "col").agg(F.sum("n").alias("n"))
    rows = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("kind", "pool", "col", "n"))).alias("rows"))

    def of(*kinds: str) -> Column:
        return F.filter("rows", lambda r: r["kind"].isin(*kinds))

    recovered = F.filter(of("recovered"), lambda r: r["n"] > 0)
    out = rows.select(*by, "rows", recovered.alias("cells"))
    out = out.withColumn("pools", F.array_sort(F.array_distinct(F.transform(of("recovered", "never"), lambda r: r["pool"]))))
    out = out.withColumn("weeks", F.array_sort(F.array_distinct(F.transform("cells", lambda r: r["col"]))))

    def total(kinds: tuple[str, ...]) -> Column:
        return F.transform("pools", lambda p: _sum(F.transform(F.filter(of(*kinds), lambda r: r["pool"] == p), lambda r: r["n"])))

    def spot(week: Column) -> Column:
        return F.coalesce(F.array_max(F.filter("weeks", lambda w: w <= week)), F.get("weeks", F.lit(0)))

    unmarked = _let(
        F.transform(of("unmarked"), lambda r: F.struct(spot(r["col"]).alias("week"), r["n"].alias("n"))),
        lambda rows: F.transform("weeks", lambda w: _sum(F.transform(F.filter(rows, lambda r: r["week"] == w), lambda r: r["n"]))),
    )
    place = {
        "pool": F.transform("cells", lambda r: (F.array_position("pools", r["pool"]) - 1).cast("int")),
        "week": F.transform("cells", lambda r: (F.array_position("weeks", r["col"]) - 1).cast("int")),
    }
    out = out.withColumns({
        "released": total(("recovered", "never")), "m_pool": total(("recovered",)), "u": unmarked, "m": F.transform("cells", lambda r: r["n"]), **place,
    })

    def places(of_what: str, names: str) -> Column:
        numbers = F.transform(names, lambda _, k: k)
        return F.transform(numbers, lambda k: F.filter(F.transform(of_what, lambda _, i: i), lambda i: F.get(of_what, i) == k))

    return out.withColumns({"in_pool": places("pool", "pools"), "in_week": places("week", "weeks")}).drop("rows", "cells")


def fixed_point_fits(cells: DataFrame, keys: Sequence[str] = (), rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Per group: n_pools, pools, capture_p, n_hat, rounds and ``still``, whether the fixed point was reached.

    ``cells`` are rows (keys, model_id, kind, row, col, pool, n). A group with a pool without recoveries, or without
    unmarked catch, has no estimates.
    """
    data = season_rows(cells, keys)
    fixed = [F.col(c) for c in ("pool", "week", "m", "u", "m_pool", "in_pool", "in_week")]

    def step(w: Column) -> Column:
        return _em_step(w, *fixed)

    def leap(w: Column, w1: Column, w2: Column) -> Column:
        """The extrapolated state, or ``w2`` where it has a negative entry."""
        first = F.zip_with(w1, w, lambda a, b: a - b)
        change = F.zip_with(F.zip_with(w2, w1, lambda a, b: a - b), first, lambda a, b: a - b)

        def along(direction: Column) -> Column:
            length = F.struct(direction.alias("r"), change.alias("v"))
            far = _let(length, lambda d: F.struct(d["r"].alias("r"), d["v"].alias("v"), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(_norm(d["r"]), _norm(d["v"])), F.lit(1.0))).alias("far")))
            moved = _let(far, lambda d: F.zip_with(F.zip_with(w, d["r"], lambda a, r: a + 2 * d["far"] * r), d["v"], lambda a, v: a + d["far"] * d["far"] * v))
            return _let(moved, lambda x: F.when(F.exists(x, lambda a: a < 0), w2).otherwise(x))

        return _let(first, along)

    largest = 1 + F.array_max("u")

    def cycle(state: Column) -> Column:
        def of_first(w1: Column) -> Column:
            gap = F.array_max(F.zip_with(w1, state["w"], lambda a, b: F.abs(a - b))) / largest
            return _let(step(w1), lambda w2: F.struct(step(leap(state["w"], w1, w2)).alias("w"), gap.alias("gap"), (state["rounds"] + 1).alias("rounds")))

        return _let(step(state["w"]), of_first)

    by_week = _let(_grouped_sum(F.col("m"), F.col("in_week")), lambda s: F.transform("m", lambda m, i: F.get("u", F.get("week", i)) * m / F.get(s, F.get("week", i))))
    start = F.struct(by_week.alias("w"), F.lit(1.0).alias("gap"), F.lit(0).alias("rounds"))
    able = ~F.exists("m_pool", lambda m: m <= 0) & (F.size("m") > 0) & (F.coalesce(_sum(F.col("u")), F.lit(0.0)) > 0)
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: F.when(state["gap"] > tolerance, cycle(state)).otherwise(state))
    out = data.withColumn("state", F.when(able, solved))
    odds = F.zip_with(_grouped_sum(F.col("state.w"), F.col("in_pool")), "m_pool", lambda w, m: w / m)
    out = out.withColumn("odds", F.when(able, odds))
    return out.select(
        *keys, "model_id", F.size("pools").alias("n_pools"), "pools", F.transform("odds", lambda b: 1 / (1 + b)).alias("capture_p"),
        F.when(able, _sum(F.zip_with("odds", "released", lambda b, n: (1 + b) * n))).alias("n_hat"),
        F.col("state.rounds").alias("rounds"), F.coalesce(F.col("state.gap") <= tolerance, F.lit(False)).alias("still"),
    )
