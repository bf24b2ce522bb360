"""Bands, sketches, ages per animal, skew-safe joins, window tables, stored series, the two-way table."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import REGISTRY
from catalog.tables import Tables
from tallyweir.operators import aggregates, biology, joins, profile, recapture, regression
from tallyweir.sources import readers, writers
from tests.goldens import SEASON_A, matrix_rows
from tests.oracle import compare, plan


def dense_band(x, y, points, span=0.75):
    def weights(at):
        d = np.abs(x - at)
        h = np.sort(d)[int(np.floor(len(x) * span + 1e-5)) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        design = np.vander(x - at, 3, increasing=True)
        return np.linalg.solve(design.T @ (w[:, None] * design), design.T * w)[0]

    hat = np.array([weights(v) for v in x])
    rss = ((y - hat @ y) ** 2).sum()
    df = len(x) - 2 * np.trace(hat) + (hat * hat).sum()
    rows = np.array([weights(v) for v in points])
    return rows @ y, np.sqrt(rss / df * (rows * rows).sum(axis=1)), np.trace(hat), df


def test_local_band_against_the_dense_hat_matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(100, 160, 150).astype(float)
    y = np.sin(x / 9) + rng.normal(0, 0.2, 150)
    both = [("a", float(a), float(b)) for a, b in zip(x, y)] + [(None, float(a), float(b) + 3) for a, b in zip(x, y)]
    df = spark.createDataFrame(both, "k STRING, x DOUBLE, y DOUBLE")
    rows = regression.local_band(df, "x", "y", ["k"], grid=15).orderBy("k", "x").collect()
    for key, shift in ((None, 3.0), ("a", 0.0)):
        mine = [r for r in rows if r.k == key]
        smooth, se, trace, df_ = dense_band(x, y + shift, [r.x for r in mine])
        assert [r.smooth for r in mine] == pytest.approx(smooth, rel=1e-7)
        assert [r.se for r in mine] == pytest.approx(se, rel=1e-5)
        assert mine[0].parameters == pytest.approx(trace, rel=1e-7) and mine[0].residual_df == pytest.approx(df_, rel=1e-7)
    lone = regression.local_band(df.where("k = 'a'"), "x", "y", grid=15).orderBy("x").collect()
    assert [r.se for r in lone] == pytest.approx([r.se for r in rows if r.k == "a"], rel=1e-9)


def test_quantiles_of_very_many_groups(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    got = aggregates.exact_quantiles(df, "v", (0.25, 0.5), ["g"])
    want = df.groupBy("g").agg(F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.5).alias("b"))
    assert got.count() == 100_000
    assert got.join(want, "g").where("q0 <> a OR q1 <> b OR n <> 3").count() == 0


def test_a_bracket_that_misses_its_rank_is_read_again(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 20_000), np.full(5_000, 0.5), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE").repartition(6)
    got = aggregates.exact_quantiles(df, "v", (0.01, 0.5, 0.99), size=8, band=0.0005).first()
    assert [got.q0, got.q1, got.q2] == pytest.approx(np.quantile(values, [0.01, 0.5, 0.99]).tolist())


def test_sketches_of_parts_can_be_merged_later(spark):
    df = spark.range(50_000).select((F.col("id") % 5).alias("day"), F.col("id").cast("double").alias("v"))
    stored = aggregates.quantile_sketches(df, "v", ["day"])
    median = stored.agg(F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("sketch"), F.lit(0.5)).alias("m")).first().m
    assert abs(median - 25_000) < 150


def test_every_unaged_animal_gets_an_age(spark):
    random.seed(3)
    aged = spark.createDataFrame([(random.uniform(60, 100), random.choice([22, 33, 44])) for _ in range(200)], "l DOUBLE, age INT")
    key = biology.age_length_key(aged, "l", "age", 5.0)
    unaged = spark.createDataFrame([(i, random.choice([None, 72.0, 72.0, random.uniform(55, 110)])) for i in range(700)], "id INT, l DOUBLE")
    out = biology.assigned_ages(unaged, key, "l", "age", 5.0, ["id"]).collect()
    assert len(out) == 700 and len({r.id for r in out}) == 700
    shares = {(r.length_bin, r.age): r.share for r in key.collect()}
    bins = {b for b, _ in shares}
    for b in bins:
        own = sorted((r for r in out if r.length_bin == b), key=lambda r: (r.l, r.id))
        assert all(r.assigned_age for r in own)
        assert [r.assigned_age for r in own] == sorted(r.assigned_age for r in own)  # longer animals are older
        for age in (22, 33, 44):
            n = sum(r.assigned_age == age for r in own)
            assert abs(n - len(own) * shares.get((b, age), 0.0)) < 1
    assert all(r.assigned_age is None for r in out if r.l is None or r.length_bin not in bins)


def test_growth_is_taken_out(spark):
    rows = [(1, d, 50 + 0.5 * d + 10 * age, age) for age in (22, 33) for d in range(100, 160, 3 if age == 22 else 5)] + [(2, 10, 70.0, 22)]
    fish = spark.createDataFrame([(y, d, float(v), a) for y, d, v, a in rows], "year INT, d INT, l DOUBLE, age INT")
    out = biology.growth_corrected(fish, fish, "l", F.col("d"), "age", name="c").collect()
    for age in (22, 33):
        assert np.ptp([r.c for r in out if r.year == 1 and r.age == age]) == pytest.approx(0, abs=1e-9)
    assert [r.c for r in out if r.year == 2] == [70.0]


@pytest.mark.parametrize("null_safe", [True, False])
def test_skew_safe_full_join_equals_the_plain_one(spark, null_safe):
    random.seed(7)
    left = spark.createDataFrame([(random.choice(["hot"] * 5 + ["a", "b", None, "left"]), i) for i in range(200)], "k STRING, x INT")
    right = spark.createDataFrame([(random.choice(["hot"] * 2 + ["a", None, "right"]), i) for i in range(40)], "k STRING, y INT")
    want = sorted(map(str, joins.full_join(left, right, ["k"], null_safe).collect()))
    for most in (7, 1_000):
        assert sorted(map(str, joins.skew_safe_full_join(left, right, ["k"], null_safe, most_rows=most).collect())) == want


def test_no_task_reads_a_hot_key_alone(spark):
    left = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k STRING, y INT")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = joins.skew_safe_full_join(left, right, ["k"], most_rows=1_000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40_001 and max(sizes) < 0.4 * 40_000


def rows_of(node, name):
    """Rows that all operators of one kind made in an executed plan."""
    own = node.metrics().apply("numOutputRows").value() if node.nodeName() == name else 0
    return own + sum(rows_of(node.children().apply(i), name) for i in range(node.children().size()))


@pytest.mark.parametrize("part_rows", [1_000_000, 50])
def test_copies_of_a_hot_key_follow_the_tasks(spark, monkeypatch, part_rows):
    monkeypatch.setattr(joins, "PART_ROWS", part_rows, raising=False)
    left = spark.range(1_200).selectExpr("IF(id < 800, 'hot', 'left') AS k", "id AS x")
    right = spark.range(500).selectExpr("IF(id < 400, 'hot', 'right') AS k", "id AS y")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = joins.skew_safe_full_join(left, right, ["k"], most_rows=5)
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(rows) == len(set(rows)) == 800 * 400 + 400 + 100
    # parts of five rows would take 800 x 80 + 400 x 160 copies
    assert 1_200 < rows_of(out._jdf.queryExecution().executedPlan(), "Generate") <= 14_000


@pytest.mark.parametrize("null_safe", [True, False])
def test_skew_safe_full_join_by_two_keys_with_nulls(spark, null_safe):
    random.seed(8)
    pair = lambda a, b: (random.choice([*a, None]), random.choice([*b, None]))
    left = spark.createDataFrame([(*pair("aab", (1.0, -0.0)), i) for i in range(150)], "k STRING, v DOUBLE, x INT")
    right = spark.createDataFrame([(*pair("aac", (1.0, 0.0, float("nan"))), i) for i in range(90)], "k STRING, v DOUBLE, y INT")
    want = sorted(str(r).replace("-0.0", "0.0") for r in joins.full_join(left, right, ["k", "v"], null_safe).collect())
    for most in (3, 20, 1_000):
        got = joins.skew_safe_full_join(left, right, ["k", "v"], null_safe, most_rows=most).collect()
        assert sorted(str(r).replace("-0.0", "0.0") for r in got) == want


def test_ten_thousand_windows_without_a_nested_loop(spark):
    random.seed(5)
    day = dt.date(1990, 1, 1)
    windows = []
    for i in range(10_000):
        a = day + dt.timedelta(days=random.randrange(9000))
        windows.append((i % 500, a, a + dt.timedelta(days=random.choice([0, 3, 40, 200, -1]))))
    windows += [(1, None, day), (None, day, day)]
    rows = [(random.randrange(600), day + dt.timedelta(days=random.randrange(9300))) for _ in range(3_000)] + [(1, None), (None, day)]
    table = spark.createDataFrame(windows, "stock INT, first DATE, last DATE")
    out = joins.in_window_table(spark.createDataFrame(rows, "stock INT, d DATE"), table, "d", ["stock"])
    known = [w for w in windows if None not in w]
    by_stock = {}
    for s, a, b in known:
        by_stock.setdefault(s, []).append((a, b))
    want = [r for r in rows if r[1] and any(a <= r[1] <= b for a, b in by_stock.get(r[0], []))]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_a_stored_series_is_pruned_and_partly_rewritten(spark, tmp_path):
    day = dt.date(2001, 12, 1)
    rows = [(s, day + dt.timedelta(days=k), float(k)) for s in "ABC" for k in range(60)]
    series = spark.createDataFrame(rows, "station_number STRING, date DATE, value DOUBLE")
    path = str(tmp_path / "series")
    writers.store_series(series, path)
    writers.store_series(series.where("station_number = 'B' AND year(date) = 2002").withColumn("value", F.lit(-1.0)), path)
    one = readers.stored_series(spark, path, "B", "2001-12-30", "2002-01-02")
    assert sorted((r.date.day, r.value) for r in one.collect()) == [(1, -1.0), (2, -1.0), (30, 29.0), (31, 30.0)]
    filters = [line for line in plan(one).splitlines() if line.startswith("PartitionFilters")]
    assert filters and "station_number" in filters[0] and "year" in filters[0]
    chosen = spark.createDataFrame([("A",), ("C",), ("A",)], "station_number STRING")
    two = readers.stored_series(spark, path, chosen, "2002-01-01")
    assert two.count() == 2 * 29 and {r.station_number for r in two.collect()} == {"A", "C"}
    assert spark.read.parquet(path).count() == 180


def test_the_published_table_with_its_margins(spark):
    monday = dt.date(2024, 5, 6)
    matrix = spark.createDataFrame(matrix_rows(SEASON_A, "s"), "season STRING, release_week DATE, recover_week DATE, kind STRING, n DOUBLE")
    label = lambda week: (F.datediff(week, F.lit(monday)) / 7).cast("int").cast("string")
    rows = {r.release: r for r in recapture.two_way_table(matrix, [str(k) for k in range(8)], label, ["season"]).collect()}
    for i in range(9):
        row = rows[str(i) if i < 8 else "unmarked"]
        line = [row[str(j)] for j in range(8)] + [row.never]
        assert line == [float(v) for v in SEASON_A[i]] and row.total == sum(SEASON_A[i])
    assert [rows["total"][str(j)] for j in range(8)] == [float(sum(line[j] for line in SEASON_A)) for j in range(8)]
    assert rows["total"].total == sum(map(sum, SEASON_A)) and len(rows) == 10


def test_sketch_profile_of_a_wide_table(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 7).alias("day"), F.col("id").alias("key"), (F.col("id") % 900).cast("string").alias("code"),
        F.when(F.col("id") % 3 > 0, F.lit(1.5)).alias("half"), F.lit(None).cast("string").alias("void"),
    )
    parts = profile.column_sketches(df, keys=["day"])
    assert parts.count() == 7 * 4
    rows = {r.column_name: r for r in profile.merged_profile(parts).collect()}
    exact = {r.column_name: r.n_distinct for r in profile.exact_distinct_counts(df, ["key", "code", "half", "void"], slices=3).collect()}
    assert exact == {"key": 60_000, "code": 900, "half": 1, "void": 0}
    for name, n in exact.items():
        assert abs(rows[name].n_distinct_approx - n) <= 4 * profile.DISTINCT_ERROR * n + 1
    assert (rows["half"].n_known, rows["half"].n_missing, rows["half"].most_frequent[0]["count"]) == (40_000, 20_000, 40_000)
    assert {t["count"] for t in rows["code"].most_frequent} == {67} and rows["void"].most_frequent == []
    assert profile.merged_profile(parts, ["day"]).count() == 28
    assert "Expand" not in plan(profile.exact_distinct_counts(df, slices=2))


def test_profile_of_a_column_without_a_frequent_value(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id % 50 AS l_suppkey", "CAST(1 + id % 7 AS INT) AS l_linenumber", "CAST(1 + id % 50 AS DOUBLE) AS l_quantity",
        "CAST(900 + id AS DOUBLE) AS l_extendedprice", "(id % 11) / 100D AS l_discount", "(id % 9) / 100D AS l_tax", "IF(id % 2 = 0, 'A', 'N') AS l_returnflag",
        "IF(id % 3 = 0, 'O', 'F') AS l_linestatus", "TIMESTAMP_NTZ '1996-01-01 00:00:00' + make_dt_interval(CAST(id % 700 AS INT)) AS l_shipdate",
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    query = REGISTRY["column_sketch_profile"]
    assert compare(query.run(Tables(spark, str(tmp_path))), con, query.sql) == []
