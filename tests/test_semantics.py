"""Missing-value, rounding, calendar and class rules on small literal frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweir.functions import dates, missing, numbers
from tallyweir.operators import aggregates, checks, joins, ordering, reshape


def values(df, column):
    return [row[column] for row in df.collect()]


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame([(1, "a", 2.0), (2, None, None), (3, "b", 0.0)], "id INT, x STRING, v DOUBLE").orderBy("id")


def test_membership_is_never_unknown(letters):
    assert values(letters.select(missing.in_set("x", ["a"]).alias("r")), "r") == [True, False, False]
    assert values(letters.select(missing.in_set("x", ["a", None]).alias("r")), "r") == [True, True, False]
    assert values(missing.keep_in(letters, "x", ["b", None]), "id") == [2, 3]


def test_not_equal_drops_missing(letters):
    assert values(letters.where(F.col("x") != "a"), "id") == [3]


def test_unknown_condition_gives_unknown(letters):
    assert values(letters.select(missing.if_else(F.col("v") > 1, "hi", "lo").alias("r")), "r") == ["hi", None, "lo"]


def test_sums_over_nothing_and_with_gaps(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", None), ("h", 2.0), ("e", None)], "k STRING, v DOUBLE")
    out = {
        r["k"]: (r["known"], r["strict"], r["cond"], r["cond_strict"])
        for r in df.groupBy("k").agg(
            missing.sum_known("v").alias("known"), missing.sum_strict("v").alias("strict"),
            missing.sum_where(F.col("v") > 5, "v").alias("cond"),
            missing.strict_sum_where(F.col("k") == "g", "v").alias("cond_strict"),
        ).collect()
    }
    assert out == {"g": (1.0, None, 0.0, None), "h": (2.0, 2.0, 0.0, 0.0), "e": (0.0, None, 0.0, 0.0)}
    empty = df.where("k = 'none'").agg(missing.sum_known("v").alias("a"), missing.sum_strict("v").alias("b"))
    assert empty.first() == (0.0, 0.0)


def test_mean_and_ratio_fallbacks(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0)], "a DOUBLE, b DOUBLE")
    assert values(df.select(missing.ratio_or("a", "b", 0.0).alias("r")), "r") == [0.0, 0.5]
    assert df.where("a > 5").agg(missing.mean_or("a", 1.0)).first()[0] == 1.0
    assert values(spark.sql("SELECT double('NaN') AS x").select(missing.nan_to_null("x").alias("r")), "r") == [None]


def test_missing_counts_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "x STRING")
    assert df.agg(missing.n_distinct_with_missing("x")).first()[0] == 3


def test_recode(letters):
    assert values(letters.select(missing.recode("x", {"a": "A"}).alias("r")), "r") == ["A", None, "b"]
    assert values(letters.select(missing.recode("x", {"a": "A"}, keep_unmatched=False).alias("r")), "r") == ["A", None, None]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (-1.5,), (1.5,)], "x DOUBLE")
    assert values(df.select(numbers.round_even("x").alias("r")), "r") == [0.0, 2.0, -2.0, 2.0]


def test_length_class_edges(spark):
    lengths = [69.9, 70.0, 85.0, 85.5, 86.0, 115.0, 115.5, 116.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "i INT, x DOUBLE").orderBy("i")
    assert values(df.select(numbers.length_class("x").alias("r")), "r") == [
        "little", "small", "small", None, "big", "big", None, "bigger", None,
    ]


def test_bins_and_percent_text(spark):
    df = spark.createDataFrame([(83.0,)], "x DOUBLE")
    assert df.select(numbers.bin_floor("x", 50)).first()[0] == 50.0
    centred = spark.createDataFrame([(0,), (2,), (3,), (7,), (8,)], "x INT")
    assert values(centred.select(numbers.bin_centre("x", 5).alias("r")), "r") == [0.0, 0.0, 5.0, 5.0, 10.0]
    texts = spark.createDataFrame([(0.5,), (12.0,), (100.0,), (None,), (3.25,), (0.0,)], "x DOUBLE")
    assert values(texts.select(numbers.percent_text("x").alias("r")), "r") == ["0.5%", "12%", "100%", "0%", "3.25%", "0%"]


def test_calendar_rules(spark):
    days = [dt.date(2024, 12, 30), dt.date(2024, 2, 29), dt.date(2023, 3, 1), dt.date(2021, 1, 3)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i INT, d DATE").orderBy("i")
    out = df.select(
        dates.iso_week("d").alias("w"), dates.iso_year("d").alias("y"), dates.block_week("d").alias("b"),
        dates.overlay_date("d").alias("o"), dates.weekday_number("d").alias("wd"), dates.week_day_code("d").alias("code"),
    ).collect()
    assert [(r.w, r.y) for r in out] == [(1, 2025), (9, 2024), (9, 2023), (53, 2020)]
    assert [r.b for r in out] == [53, 9, 9, 1]
    assert [r.o for r in out] == [dt.date(2024, 12, 30), dt.date(2024, 2, 29), dt.date(2024, 2, 29), dt.date(2024, 1, 3)]
    assert [r.wd for r in out] == [2, 5, 4, 1]
    assert [r.code for r in out] == [1.365, 9.6, 9.6, 53.3]


def test_dates_in_two_formats(spark):
    df = spark.createDataFrame([("2024-05-06",), ("05/06/2024",), ("soon",), (None,)], "x STRING")
    assert values(df.select(dates.parse_date("x").alias("r")), "r") == [dt.date(2024, 5, 6)] * 2 + [None, None]


def test_clock_time_on_another_date(spark):
    df = spark.sql("SELECT DATE'2025-05-07' AS d, TIMESTAMP_NTZ'1899-12-31 08:15:00' AS a, TIMESTAMP_NTZ'1899-12-31 09:45:00' AS b")
    row = df.select(dates.with_time_of_day("d", "a").alias("t"), dates.minutes_between("a", "b").alias("m")).first()
    assert row.t == dt.datetime(2025, 5, 7, 8, 15) and row.m == 90.0


def test_windows_are_inclusive(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2022-05-01', DATE'2022-05-05')) AS d")
    assert values(df.select(dates.in_windows("d", [("2022-05-02", "2022-05-04")]).alias("r")), "r") == [False, True, True, True, False]


def test_joins_match_missing_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("z", 3)], "k STRING, a INT")
    b = spark.createDataFrame([("x", 10), (None, 20), ("y", 30)], "k STRING, b INT")
    left = {(r.k, r.a, r.b) for r in joins.left_join(a, b, ["k"]).collect()}
    assert left == {("x", 1, 10), (None, 2, 20), ("z", 3, None)}
    assert {(r.k, r.a, r.b) for r in joins.left_join(a, b, ["k"], null_safe=False).collect()} == {
        ("x", 1, 10), (None, 2, None), ("z", 3, None)}
    full = {(r.k, r.a, r.b) for r in joins.full_join(a, b, ["k"]).collect()}
    assert full == left | {("y", None, 30)}
    assert {r.k for r in joins.unmatched(a, b, ["k"]).collect()} == {"z"}
    assert joins.natural_keys(a, b) == ["k"]


def test_pivot_fills_absent_cells_only(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", None), ("b", "p", 2.0)], "k STRING, s STRING, v DOUBLE")
    wide = {r.k: (r.p, r.q, r.r) for r in reshape.to_wide(df, ["k"], "s", ["p", "q", "r"], F.sum("v")).collect()}
    assert wide == {"a": (1.0, None, 0.0), "b": (2.0, 0.0, 0.0)}


def test_sort_orders(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("z",)], "x STRING")
    assert values(ordering.sort_missing_last(df, "x", descending=True), "x") == ["z", "b", "a", None]
    assert values(df.orderBy(*ordering.by_levels("x", ["z", "a"])), "x") == ["z", "a", "b", None]


def test_distinct_text_and_contingency(spark):
    df = spark.createDataFrame([("r", "t"), ("r", "b"), ("r", None), ("s", None), (None, "t")], "k STRING, x STRING")
    assert {(r.k, r.m) for r in df.groupBy("k").agg(aggregates.distinct_text("x").alias("m")).collect()} == {
        ("r", "b,t"), ("s", ""), (None, "t")}
    assert {(r.k, r.x, r.n, r.share) for r in aggregates.contingency(df, "k", "x").collect()} == {
        ("r", "t", 1, 0.5), ("r", "b", 1, 0.5)}


def test_required_rows(letters):
    assert checks.require_rows(letters, "empty") is letters
    with pytest.raises(ValueError, match="empty"):
        checks.require_rows(letters.where("id > 9"), "empty")


def test_durations_ignore_the_session_time_zone(spark):
    """Two in the morning does not exist on this date in the chosen zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 01:30:00' AS a, TIMESTAMP_NTZ'2024-03-10 04:00:00' AS b")
        assert tuple(df.select(dates.minutes_between("a", "b"), dates.hours_between("b", "a")).first()) == (150.0, -2.5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
