"""Scans, sinks and presentation (SRC, SNK)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.tables import Tables
from tallyweir.operators.joins import left_join
from tallyweir.plans import tagging
from tallyweir.session import ensure_checkpoint_dir
from tallyweir.sources import readers, schemas, writers


def scratch_folder(t: Tables, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(t.spark)
    base = t.spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query(
    "SRC-01",
    """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def typed_table_scan(t: Tables) -> DataFrame:
    orders = t.raw("orders")
    out = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(out, 2)


@query(
    "SRC-02 SNK-01 PRJ-09",
    """SELECT tag_date, tag_code, head_mold_size, inj_n, mort_n, sacrifice_n, r_check_date, r_retention_n,
         r_sample_size, r_re_tagged_n FROM sv_log""",
)
def csv_round_trip_with_schema(t: Tables) -> DataFrame:
    """The whole tagging log written as CSV and read back under its fixed schema."""
    folder = scratch_folder(t, "log-csv")
    writers.write_csv(t.log, folder)
    return readers.read_csv(t.spark, folder, schemas.TAG_LOG)


@query(
    "SRC-03 PRJ-09",
    """SELECT site, count(*) AS n, count(water_level_m) AS n_level, round(sum(water_level_m), 4) AS level
       FROM sv_trap GROUP BY 1""",
)
def csv_text_then_cast(t: Tables) -> DataFrame:
    """Untyped CSV columns cast afterwards; cells that do not fit become NULL."""
    folder = scratch_folder(t, "trap-csv")
    writers.write_csv(t.trap, folder)
    rows = readers.typed(readers.read_csv(t.spark, folder), schemas.TRAP_EFFORT)
    out = rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.count("water_level_m").alias("n_level"), F.sum("water_level_m").alias("level")
    )
    return rounded(out, 4)


@query(
    "SRC-04",
    """SELECT CAST(ts AS DATE) AS date, parameter, round(avg(value), 10) AS value, count(*) AS n
       FROM sv_units GROUP BY 1, 2""",
)
def instrument_export_scan(t: Tables) -> DataFrame:
    """Instrument text files with preamble and header lines above the readings."""
    folder = scratch_folder(t, "unit-values")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    lines = t.units.select(
        F.concat_ws(",", stamp, F.col("parameter"), F.col("value").cast("string"), F.lit("Final"), F.lit("")).alias("value")
    )
    notes = t.stations.select(F.concat(F.lit("# station "), "station_name").alias("value"))
    heads = t.stations.select(F.lit("Date,Parameter,Value,Approval,Qualifier").alias("value"))
    notes.unionByName(heads).unionByName(lines).write.text(folder)
    units = readers.read_unit_values(t.spark, folder, schemas.UNIT_VALUES)
    day = F.to_date(F.substring("Date", 1, 10)).alias("date")
    out = units.groupBy(day, F.col("Parameter").alias("parameter")).agg(
        F.avg("Value").alias("value"), F.count(F.lit(1)).alias("n")
    )
    return rounded(out, 10)


@query(
    "SRC-05",
    """SELECT f.head_mold_size, k.length_range_mm, count(*) AS n
       FROM sv_fish f LEFT JOIN (VALUES (NULL, '<70'), ('10', '70-85'), ('15', '86-115'), ('20', '116-190'))
         AS k(head_mold_size, length_range_mm) ON f.head_mold_size IS NOT DISTINCT FROM k.head_mold_size
       GROUP BY 1, 2""",
)
def literal_lookup(t: Tables) -> DataFrame:
    key = readers.literal_table(t.spark, tagging.MOLD_KEY, "head_mold_size STRING, length_range_mm STRING")
    counts = t.fish.groupBy("head_mold_size").agg(F.count(F.lit(1)).alias("n"))
    return left_join(counts, key, ["head_mold_size"])


@query(
    "SRC-06",
    """SELECT CAST(l_linenumber AS INT) AS l_linenumber, round(sum(l_quantity * w.value), 2) AS weighted
       FROM lineitem JOIN (VALUES (1, 1, 0.5), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 3.0)) AS w(r, c, value)
         ON w.r = CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AND w.c = 1 + l_linenumber % 2
       GROUP BY 1""",
)
def literal_matrix_weights(t: Tables) -> DataFrame:
    """A typed-in matrix in long form, joined to the observations by row and column."""
    weights = readers.literal_matrix(t.spark, [[0.5, 2.0], [1.0, 3.0]], "r", "c")
    r = F.when(F.col("l_linestatus") == "O", 1).otherwise(2)
    cells = t.raw("lineitem").groupBy("l_linenumber", r.alias("r"), (1 + F.col("l_linenumber") % 2).alias("c")).agg(
        F.sum("l_quantity").alias("q")
    )
    out = cells.join(weights, ["r", "c"]).groupBy("l_linenumber").agg(
        F.sum(F.col("q") * F.col("value")).alias("weighted")
    )
    return rounded(out, 2)


@query(
    "SRC-07 FLT-07",
    """SELECT station_number, date, parameter, round(value, 10) AS value FROM sv_hydro
       WHERE station_number = '2-HIGH' AND date >= DATE '1998-01-01'""",
)
def station_range_scan(t: Tables) -> DataFrame:
    return rounded(readers.station_series(t.hydro, "2-HIGH", "1998-01-01"), 10)


@query("SRC-08", "SELECT station_number, station_name, region FROM sv_stations WHERE station_number = 'NATION_7'")
def station_metadata(t: Tables) -> DataFrame:
    return t.stations.where(F.col("station_number") == "NATION_7")


@query(
    "SRC-09 SCL-03 SCL-04 SCL-05",
    """WITH span AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders),
       days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
       SELECT date, CAST(year(date) AS INT) AS year, CAST((dayofyear(date) - 1) // 7 + 1 AS INT) AS week,
         CAST(dayofweek(date) + 1 AS INT) AS weekday FROM days""",
)
def calendar_spine(t: Tables) -> DataFrame:
    """Every day between the first and the last order."""
    from tallyweir.functions import dates

    day = F.col("o_orderdate").cast("date")
    span = t.raw("orders").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    return days.select(
        "date", F.year("date").alias("year"), dates.block_week("date").alias("week"),
        dates.weekday_number("date").alias("weekday"),
    )


@query(
    "SNK-02 PRJ-02 SRT-03",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'Open' ELSE o_orderstatus END
         AS "Status", count(*) AS "# Orders" FROM orders GROUP BY 1""",
)
def presented_table(t: Tables) -> DataFrame:
    from tallyweir.functions.missing import recode

    status = recode("o_orderstatus", {"F": "Finished", "O": "Open"}).alias("status")
    out = t.raw("orders").groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return writers.present(out, {"status": "Status", "n": "# Orders"})
