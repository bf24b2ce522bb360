"""Hot keys, row numbering, sources and plan shapes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalog import REGISTRY
from catalog.tables import Tables
from tallyweir.operators import aggregates, ordering
from tallyweir.session import ensure_checkpoint_dir
from tallyweir.sources import readers, schemas, writers
from tests.oracle import plan


def test_row_ids_with_a_hot_value(spark):
    """Half of the rows share the leading sort value; ids are still 1..n in order."""
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    out = ordering.with_row_id(df.repartition(6), ["k", "v"])
    rows = out.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(1, 5001))
    assert [(r.k, r.v) for r in rows] == sorted((r.k, r.v) for r in rows)


def test_quantiles_with_a_hot_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % 20011).cast("double").alias("v"),
    )
    mine = {r.k: (r.n, r.q0) for r in aggregates.exact_quantiles(df, "v", (0.5,), ["k"]).collect()}
    theirs = {r.k: (r.n, r.q) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.lit(0.5)).alias("q")).collect()}
    assert mine == theirs


def test_best_per_group(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k STRING, v INT, w STRING")
    assert {tuple(r) for r in ordering.best_per_group(df, ["k"], ["v"]).collect()} == {("a", 1, "y"), ("b", 5, None)}


def test_preamble_lines_are_skipped(spark, tmp_path):
    text = "\n".join(["Station,X", "Notes: 2024 data", "Date,Parameter,Value,Approval,Qualifier",
                      "2024-05-01T00:00:00-08:00,47,1.25,Final,", "2024-05-01T01:00:00-08:00,47,,Final,B"])
    (tmp_path / "unit.csv").write_text(text + "\n")
    rows = readers.read_unit_values(spark, str(tmp_path / "unit.csv"), schemas.UNIT_VALUES).collect()
    assert [(r.Date[:10], r.Value, r.Qualifier) for r in rows] == [("2024-05-01", 1.25, None), ("2024-05-01", None, "B")]


def test_headers_and_bad_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Head Mold (lbs),GR AGE,Site\n10,22,barn\nten,,\nNaN,NA,NA\n")
    df = readers.snake_columns(readers.read_csv(spark, str(tmp_path / "t.csv")))
    assert df.columns == ["head_mold_lbs", "gr_age", "site"]
    out = readers.typed(df, schemas.table("head_mold_lbs DOUBLE, gr_age INT, site STRING")).collect()
    assert [tuple(r) for r in out] == [(10.0, 22, "barn"), (None, None, None), (None, None, None)]


def test_partitioned_copy_prunes_folders(spark, folder, tmp_path):
    t = Tables(spark, folder)
    writers.write_parquet(t.hydro.withColumn("year", F.year("date")), str(tmp_path / "hydro"), ["station_number", "year"])
    back = readers.station_series(readers.read_parquet(spark, str(tmp_path / "hydro")), "2-HIGH", "1998-01-01")
    shown = plan(back.select("value"))
    assert "PartitionFilters: [isnotnull(station_number" in shown and "GreaterThanOrEqual(date" in shown
    assert back.count() == t.hydro.where("station_number = '2-HIGH' AND date >= '1998-01-01'").count()


def test_calendar_and_literals(spark):
    assert readers.calendar(spark, "2020-01-01", "2022-12-31").count() == 1096
    assert readers.literal_matrix(spark, [[1, 2], [3, 4]]).where("row = 2 AND col = 1").first().value == 3.0
    with pytest.raises(ValueError):
        readers.literal_table(spark, [(1,)] * (readers.MAX_LITERAL_ROWS + 1), "a INT")


def test_checkpoint_folder_is_set(spark):
    assert ensure_checkpoint_dir(spark)


def test_filters_and_columns_reach_the_scan(spark, folder):
    shown = plan(REGISTRY["range_conditions"].run(Tables(spark, folder)))
    assert "GreaterThan(l_quantity,10.0)" in shown and "GreaterThanOrEqual(l_shipdate" in shown
    shown = plan(REGISTRY["hours_worked_by_year"].run(Tables(spark, folder)))
    assert "o_totalprice" not in shown and "o_orderpriority" not in shown


def test_hot_join_key_is_split_at_run_time(spark):
    """A third of the left rows share one key (here: the missing one); the join still matches and is split."""
    from tallyweir.operators.joins import left_join

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 60000, numPartitions=12).select(
            F.when(F.col("id") % 3 > 0, F.col("id") % 997).alias("k"), F.xxhash64("id").alias("v")
        )
        right = spark.range(997).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionByName(
            spark.sql("SELECT CAST(NULL AS BIGINT) AS k, -1L AS w"))
        out = left_join(left, right, ["k"])
        rows = out.collect()
        assert len(rows) == 60000 and all(r.w == (-1 if r.k is None else 2 * r.k) for r in rows)
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
