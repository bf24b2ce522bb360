"""Cases in which rows were lost, multiplied or judged without a fit, and the package away from its folder."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyweir.functions.distributions import student_two_sided
from tallyweir.operators import recapture, reshape
from tallyweir.operators.accounting import apply_overrides
from tallyweir.operators.aggregates import profile
from tallyweir.plans import marks

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FISH = (
    "stock string, iso_year int, iso_week int, year_day int, date date, week date, site string, tag_status string, a_caudalclip string, "
    "r_caudalclip string, r_adclip string, count double"
)


def fish(spark, rows):
    """(stock, ISO week of 2024, site, tag status, mark, count)"""
    out = []
    for stock, week, site, status, mark, n in rows:
        day = 8 + 7 * (week - 2)  # the Monday of the week in 2024
        applied, seen = (mark, None) if status == "A" else (None, mark)
        date = f"2024-{1 + (day - 1) // 31:02d}-01"
        out.append((stock, 2024, week, day, date, date, site, status, applied, seen, "yes" if status == "R" else None, float(n)))
    text = FISH.replace("date date", "date string").replace("week date", "week string")
    df = spark.createDataFrame(out, text)
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("year_day") - 1)
    return df.withColumns({"date": start, "week": start})


def test_early_weeks_stay_out_of_the_matrix(spark):
    df = fish(spark, [
        ("a", 18, "fence", None, None, 157), ("a", 19, "barn", "A", "top", 100), ("a", 19, "fence", "R", "top", 10),
        ("a", 20, "fence", None, None, 300), ("a", 20, "fence", "R", "top", 5),
    ])
    whole = {(r.kind, str(r.recover_week)): r.n for r in marks.mark_matrix(df).collect()}
    bound = {(r.kind, str(r.recover_week)): r.n for r in marks.mark_matrix(df, first_week=19).collect()}
    assert whole["unmarked", "2024-04-29"] == 157 and ("unmarked", "2024-04-29") not in bound
    assert {k: n for k, n in whole.items() if k != ("unmarked", "2024-04-29")} == bound
    assert bound["never", "None"] == 85
    assert [r.iso_week for r in marks.weekly_unmarked(df, first_week=19).orderBy("iso_week").collect()] == [19, 20]
    assert marks.weekly_release_recapture(df, first_week=20).count() == 0


def test_stocks_do_not_mix(spark):
    rows = [("barn", "A", "top", 100), ("fence", "R", "top", 10), ("fence", None, None, 50)]
    df = fish(spark, [(s, 19, site, status, mark, n * k) for s, k in (("a", 1), ("b", 2)) for site, status, mark, n in rows])
    cells = marks.mark_matrix(df, keys=("stock", "iso_year"))
    got = {(r.stock, r.kind): r.n for r in cells.collect()}
    assert got == {(s, kind): n * k for s, k in (("a", 1), ("b", 2)) for kind, n in (("recovered", 10), ("never", 90), ("unmarked", 50))}


def test_last_override_holds_and_adds_no_rows(spark):
    rates = spark.createDataFrame([("x", 20, 0.5), ("y", 20, 0.5), ("y", 21, 0.5)], "tag_code string, iso_week int, retention double")
    over = spark.createDataFrame([("x", 20, 0.7), ("x", 20, 0.9), (None, 21, 0.1), (None, 21, 0.2)], "tag_code string, iso_week int, rate double")
    got = sorted((r.tag_code, r.iso_week, r.retention) for r in apply_overrides(rates, over.coalesce(1)).collect())
    assert got == [("x", 20, 0.9), ("y", 20, 0.5), ("y", 21, 0.2)]
    ordered = over.withColumn("no", -F.col("rate"))
    assert sorted(r.retention for r in apply_overrides(rates, ordered, order="no").collect()) == [0.1, 0.5, 0.7]


def test_unlisted_names_are_kept(spark):
    df = spark.createDataFrame([("k", "p", 1.0), ("k", "z", 5.0), ("k", None, 7.0), ("m", "z", 2.0)], "k string, s string, v double")
    wide = {r.k: (r.p, r.other) for r in reshape.to_wide(df, ["k"], "s", ["p"], F.sum("v")).collect()}
    assert wide == {"k": (1.0, 12.0), "m": (0.0, 2.0)}
    assert reshape.to_wide(df, ["k"], "s", ["p"], F.sum("v"), other=None).columns == ["k", "p"]


def test_profile_of_every_column(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "x int, y string")
    got = {r.column_name: (r.n_known, r.n_missing, r.n_distinct) for r in profile(df, exact=True).collect()}
    assert got == {"x": (3, 0, 2), "y": (2, 1, 2)}


def test_models_without_a_fit_have_no_rank(spark):
    report = spark.createDataFrame([("a", 10.0), ("b", None), ("c", 12.5)], "model_id string, aicc double")
    got = {r.model_id: (r.delta_aicc, r["rank"]) for r in recapture.rank_models(report).collect()}
    assert got == {"a": (0.0, 1), "b": (None, None), "c": (2.5, 2)}


@pytest.mark.parametrize("df", [2e6, 1e9, 1e13, 1e15])
def test_tail_of_many_degrees_of_freedom(df):
    for t in (0.0, 0.5, 2.0, 4.0):
        normal = math.erfc(t / math.sqrt(2))
        # first-order term of the tail in 1 / df
        first = 2 * t * (t * t + 1) / 4 / df * math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        assert student_two_sided(t, df) == pytest.approx(normal + first, rel=1e-9)


def test_tail_is_smooth_where_the_method_changes():
    for t in (0.5, 2.0, 5.0):
        assert student_two_sided(t, 0.999e6) == pytest.approx(student_two_sided(t, 1.001e6), rel=1e-6)


def test_fits_run_away_from_the_repository(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "rows = e.queries()['one_pool_fit'](s, '/root/testdata/sf0.001').collect()\n"
        "assert rows and any(r.n_hat for r in rows)\n"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("size, band", [(8_192, 0.003), (200, 0.05), (8, 0.001)])
def test_quantiles_of_large_values_with_a_small_spread(spark, size, band):
    import numpy as np

    from tallyweir.operators.aggregates import exact_quantiles

    rng = np.random.default_rng(5)
    offset = 1.7e9 + rng.uniform(0, 1e6, 4000)
    ties = np.repeat([1e15, 1e15 + 2, -3.0], [500, 400, 300])
    rows = [("o", float(x)) for x in offset] + [("t", float(x)) for x in ties] + [(None, 4.0), ("n", float("nan")), ("n", None)]
    rows += [("i", x) for x in (float("inf"), float("-inf"), 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.77, 1.0)
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"], size, band).collect()}
    for k, values in (("o", offset), ("t", ties), (None, np.array([4.0]))):
        assert [got[k][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert (got["i"].q0, got["i"].q2, got["i"].q3, got["i"].q5) == (float("-inf"), 1.0, 2.0, float("inf"))
    assert "n" not in got
    whole = exact_quantiles(df.where("k = 'o'"), "v", (0.5,), size=size, band=band).first()
    assert whole.q0 == pytest.approx(float(np.quantile(offset, 0.5)), rel=1e-12)


def test_pooling_by_share_pools_and_models_differ(spark):
    from catalog.tables import Tables
    from tallyweir.plans import estimates

    matrix = marks.mark_matrix(Tables(spark, "/root/testdata/sf0.01").wild)
    strata = recapture.stratum_totals(matrix, ["iso_year"])
    pools = estimates.pools_by_share(strata, estimates.ROW_SHARES)
    counts = pools.groupBy("iso_year").agg(F.count_distinct("stratum").alias("strata"), F.count_distinct("pool").alias("pools")).collect()
    assert counts and all(1 < r.pools < r.strata for r in counts)
    fits = estimates.candidate_fits(matrix, shares=estimates.ROW_SHARES).collect()
    by_model = {}
    for r in fits:
        by_model.setdefault(r.model_id, {})[r.iso_year] = r.n_pools
    assert len({tuple(sorted(x.items())) for x in by_model.values()}) == len(by_model)


def test_nothing_is_left_behind(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "import __spark_entry__ as e\n"
        "from tallyweir.session import build_session\n"
        "s = build_session('x', 'local[2]', spark__ui__enabled='false', spark__sql__shuffle__partitions='2')\n"
        "for name in ('row_ids', 'exact_quantiles_by_group'):\n"
        "    assert e.queries()[name](s, '/root/testdata/sf0.001').count()\n"
        "s.stop()\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("tallyweir")] == []
