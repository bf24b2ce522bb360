"""Survey tables derived from the given tables, once as DataFrames and once as SQL.

Each survey table is a projection of a whole given table (line items as observed animals, orders
as tagging batches, visits and gauge readings, events as trap visits, parts as age readings), with
NULLs, blank codes, hot codes and alternating weekly marks, so that every rule has data to act on.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions import dates
from tallyweir.plans import canonical
from tallyweir.plans.canonical import SeasonRule
from tallyweir.sources.readers import read_parquet
from tallyweir.sources.schemas import table

FIRST_MONDAY = "1995-01-02"

# Schemas of the given tables in use, so that no read starts with a job to find them.
GIVEN = {
    "nation": table("n_nationkey INT, n_name STRING, n_regionkey INT"),
    "customer": table("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"),
    "part": table("p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"),
    "orders": table(
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "lineitem": table(
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
        "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": table("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"),
}

# Seasons of the stand-in data; the rules have the form of the two real ones.
WILD_SEASON = SeasonRule(species=("co-w",), size_classes=(None, "small", "big", "bigger", "biggest"))
MIXED_SEASON = SeasonRule(
    size_classes=(None, "little", "small", "big"), split_clipped=True, transfer_from="1999-06-19"
)
REPEAT_RULES = (("orange", 1996), ("orange", 1998), ("pink", 1997))

# Expressions that mean the same in Spark and in DuckDB, by table: column -> text.
# {week} is the number of whole weeks since the first Monday.
_MARKED = "l_linestatus = 'O' AND l_returnflag IN ('A', 'R') AND l_linenumber <= 4"
_SEEN = "l_linestatus = 'F' AND l_returnflag = 'A' AND l_linenumber <= 3"
FISH = {
    "year": "CAST(year(l_shipdate) AS INT)",
    "date": "CAST(l_shipdate AS DATE)",
    "site": "CASE l_linestatus WHEN 'O' THEN 'barn' ELSE 'fence' END",
    "species": "CASE WHEN l_returnflag IN ('A', 'R') THEN 'co-w' WHEN l_linenumber = 1 THEN 'co-a' "
    "WHEN l_linenumber = 2 THEN 'st/rb' WHEN l_linenumber = 3 THEN 'ct' WHEN l_linenumber = 4 THEN 'ch' "
    "WHEN l_linenumber = 5 THEN 'co-f' WHEN l_linenumber = 6 THEN 'xx' END",
    "count": "CASE WHEN l_quantity < 50 THEN l_quantity END",
    "size_cwt": "CASE WHEN l_quantity <= 5 THEN NULL WHEN l_quantity <= 12 THEN 'little' WHEN l_quantity <= 20 THEN 'small' "
    "WHEN l_quantity <= 35 THEN 'big' WHEN l_quantity <= 45 THEN 'bigger' ELSE 'biggest' END",
    "mort": "CASE WHEN l_discount > 0.095 THEN 'Yes' END",
    "sacrifice": "CASE WHEN l_tax > 0.075 THEN 'YES' END",
    "a_adclip": f"CASE WHEN {_MARKED} THEN 'yes' END",
    "r_adclip": f"CASE WHEN {_SEEN} THEN 'yes' WHEN l_linestatus = 'O' AND l_linenumber = 4 AND l_tax > 0.065 THEN 'yes' END",
    "a_caudalclip": f"CASE WHEN {_MARKED} THEN CASE WHEN l_tax < 0.005 THEN 'none' WHEN {{week}} % 2 = 0 THEN 'top' "
    "ELSE 'bottom' END END",
    "r_caudalclip": f"CASE WHEN {_SEEN} THEN CASE WHEN l_linenumber = 3 THEN 'none' "
    "WHEN ({week} + l_linenumber) % 2 = 1 THEN 'top' ELSE 'bottom' END "
    "WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN CASE l_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'top' END END",
    "tag_code": "CASE WHEN l_suppkey % 7 > 0 THEN '18-' || CAST(l_suppkey % 7 AS STRING) END",
    "head_mold_size": "CASE l_linenumber WHEN 1 THEN NULL WHEN 3 THEN '15' WHEN 4 THEN '20' ELSE '10' END",
    "fork_length_mm": "CASE WHEN l_linenumber < 7 THEN 40 + floor(l_extendedprice / 350) / 2 END",
    "weight_g": "CASE WHEN l_linenumber <> 6 THEN l_extendedprice / 1000 * (0.2 + 8 * l_discount) END",
    "gr_age": "CASE l_linenumber WHEN 1 THEN '22' WHEN 2 THEN '33' WHEN 3 THEN '44' WHEN 4 THEN '' WHEN 6 THEN '99' "
    "WHEN 7 THEN '22' END",
    "row_label": "l_orderkey",
    "scale_number": "CASE WHEN l_linenumber <= 5 THEN l_partkey END",
}
LOG = {
    "tag_date": "CAST(o_orderdate AS DATE)",
    "tag_code": "CASE WHEN o_custkey % 7 > 0 THEN '18-' || CAST(o_custkey % 7 AS STRING) END",
    "head_mold_size": "CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '3-MEDIUM' THEN '15' "
    "WHEN '4-NOT SPECIFIED' THEN '20' ELSE '10' END",
    "inj_n": "CAST(floor(o_totalprice / 1000) AS DOUBLE)",
    "mort_n": "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 5 AS DOUBLE) END",
    "sacrifice_n": "CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey % 3 AS DOUBLE) END",
    "r_check_date": "CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) + 1 END",
    "r_retention_n": "CASE WHEN o_orderkey % 5 > 0 THEN CAST(50 + o_orderkey % 50 - o_orderkey % 7 AS DOUBLE) END",
    "r_sample_size": "CASE WHEN o_orderkey % 5 > 0 THEN CAST(50 + o_orderkey % 50 AS DOUBLE) END",
    "r_re_tagged_n": "CASE WHEN o_custkey % 7 <> 3 OR o_orderkey % 4 > 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END",
}
ADULT = {
    "year": "CAST(year(l_shipdate) AS INT)",
    "date": "CAST(l_shipdate AS DATE)",
    "time_of_day": "CASE WHEN l_suppkey % 2 = 0 THEN 'am' ELSE 'pm' END",
    "total": "CASE WHEN l_quantity < 50 THEN l_quantity END",
    "species": "CASE l_returnflag WHEN 'N' THEN 'ch' ELSE 'co' END",
    "mark_gender": "CASE l_linenumber WHEN 1 THEN 'af' WHEN 2 THEN 'wf' WHEN 3 THEN 'am' WHEN 4 THEN 'wm' WHEN 5 THEN 'wj' "
    "WHEN 6 THEN 'aj' END",
    "recap_tag_colour": "CASE l_partkey % 10 WHEN 0 THEN 'orange' WHEN 1 THEN 'pink' END",
    "broodstock": "CASE WHEN l_discount > 0.095 THEN TRUE WHEN l_discount < 0.005 THEN FALSE END",
    "scale_book": "CASE WHEN l_linenumber <= 3 THEN l_suppkey END",
    "fork_length_mm": "300 + l_extendedprice / 350",
}
VISITS = {
    "year": "CAST(year(o_orderdate) AS INT)",
    "date": "CAST(o_orderdate AS DATE)",
    "time_of_day": "CASE WHEN o_custkey % 2 = 0 THEN 'am' ELSE 'pm' END",
    "arrival_time": "{plus:o_orderdate:(o_custkey % 12) * 60}",
    "departure_time": "CASE WHEN o_orderstatus <> 'P' THEN {plus:o_orderdate:(o_custkey % 12) * 60 + o_orderkey % 240} END",
}
HYDRO_UNITS = {
    "station_number": "o_orderpriority",
    "ts": "{plus:o_orderdate:(o_custkey % 24) * 60}",
    "parameter": "CASE o_orderstatus WHEN 'F' THEN 'Level' ELSE 'Flow' END",
    "value": "o_totalprice / 99991",
}
TRAP = {
    "date": "CAST(ts AS DATE)",
    "site": "CASE WHEN user_id % 2 = 0 THEN 'barn' ELSE 'fence' END",
    "type": "CASE WHEN event_type IN ('click', 'view', 'error') THEN 'pull' ELSE 'set' END",
    "arrival_time_24h": "{minute:ts:0}",
    "departure_time_24h": "CASE WHEN event_type <> 'error' THEN {minute:ts:event_id % 180} END",
    "water_level_m": "CASE WHEN event_type <> 'error' THEN value / 97 END",
    "water_temp_c": "CASE WHEN value < 90 THEN value / 11 END",
}
AGES = {
    "gr_age": "CAST(p_size AS STRING)",
    "eu_age": "p_type",
    "age_code": "CASE WHEN p_size % 5 > 0 THEN 'ok' END",
    "address": "CASE WHEN p_size % 9 = 0 THEN 'bad' ELSE CAST(p_partkey AS STRING) END",
    "sp": "p_name",
    "source": "p_brand",
    "life_stage": "CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'Juvenile' ELSE 'Adult' END",
    "start_date": "DATE '1995-01-01' + CAST(p_partkey % 2500 AS INT)",
    "label": "p_brand || '-' || CAST(p_partkey AS STRING)",
}
STATIONS = {
    "station_number": "n_name",
    "station_name": "'Station ' || CAST(n_nationkey AS STRING)",
    "region": "CAST(n_regionkey AS STRING)",
}

_SOURCES = {
    "sv_fish": ("lineitem", FISH),
    "sv_log": ("orders", LOG),
    "sv_adult": ("lineitem", ADULT),
    "sv_visits": ("orders", VISITS),
    "sv_units": ("orders", HYDRO_UNITS),
    "sv_trap": ("events", TRAP),
    "sv_ages": ("part", AGES),
    "sv_stations": ("nation", STATIONS),
}


def _dialect(text: str, spark: bool) -> str:
    """Fill in the few expressions the two engines spell differently."""
    if spark:
        week = f"(datediff(CAST(l_shipdate AS DATE), DATE '{FIRST_MONDAY}') div 7)"
    else:
        week = f"(date_diff('day', DATE '{FIRST_MONDAY}', CAST(l_shipdate AS DATE)) // 7)"
    out = text.replace("{week}", week)
    while "{plus:" in out or "{minute:" in out:
        start = max(out.rfind("{plus:"), out.rfind("{minute:"))
        end = out.index("}", start)
        kind, stamp, minutes = out[start + 1:end].split(":", 2)
        if spark:
            base = stamp if kind == "plus" else (
                f"make_timestamp_ntz(year({stamp}), month({stamp}), day({stamp}), hour({stamp}), minute({stamp}), 0)"
            )
            new = f"timestampadd(MINUTE, CAST({minutes} AS INT), {base})"
        else:
            base = f"CAST({stamp} AS TIMESTAMP)" if kind == "plus" else f"date_trunc('minute', {stamp})"
            new = f"({base} + to_minutes(CAST({minutes} AS INT)))"
        out = out[:start] + new + out[end + 1:]
    return out


def _select(source: str, columns: dict[str, str]) -> str:
    body = ",\n  ".join(f'{_dialect(text, spark=False)} AS "{name}"' for name, text in columns.items())
    return f"SELECT\n  {body}\nFROM {source}"


_CALENDAR_SQL = """CAST(isoyear(date) AS INT) AS iso_year, CAST(week(date) AS INT) AS iso_week,
  CAST(dayofyear(date) AS INT) AS year_day, CAST(date_trunc('week', date) AS DATE) AS week,
  weight_g / (fork_length_mm * fork_length_mm * fork_length_mm) * 100000.0 AS k"""
_FATE_SQL = "CASE WHEN sacrifice IS NOT NULL THEN 'sacrifice' WHEN mort IS NOT NULL THEN 'mort' ELSE 'live' END"
_STATUS_SQL = (
    f"CASE WHEN a_adclip IS NOT NULL AND ({_FATE_SQL}) = 'live' THEN 'A' WHEN r_adclip IS NOT NULL THEN 'R' END"
)

SQL: dict[str, str] = {name: _select(source, columns) for name, (source, columns) in _SOURCES.items()}
SQL["sv_hydro"] = """
SELECT station_number, CAST(ts AS DATE) AS date, parameter, avg(value) AS value FROM sv_units GROUP BY ALL"""
SQL["sv_releases"] = """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(count(DISTINCT o_custkey) * 40 AS DOUBLE) AS cwt_released
FROM orders GROUP BY 1"""
SQL["sv_wild"] = f"""
SELECT *, {_FATE_SQL} AS fate, {_STATUS_SQL} AS tag_status, site AS release_site, {_CALENDAR_SQL}
FROM sv_fish
WHERE species = 'co-w' AND (size_cwt IN ('small', 'big', 'bigger', 'biggest') OR size_cwt IS NULL)"""
SQL["sv_mixed"] = f"""
SELECT * REPLACE (CASE WHEN species = 'co-a' AND r_caudalclip = 'none' THEN 'co-h'
    WHEN species = 'co-a' AND r_caudalclip IN ('top', 'bottom') THEN 'co-w.r' ELSE species END AS species),
  {_FATE_SQL} AS fate, {_STATUS_SQL} AS tag_status,
  CASE WHEN date >= DATE '1999-06-19' AND a_caudalclip IN ('top', 'bottom') THEN 'barn' ELSE site END AS release_site,
  {_CALENDAR_SQL}
FROM sv_fish
WHERE size_cwt IN ('little', 'small', 'big') OR size_cwt IS NULL"""


class Tables:
    """The given tables under one folder, and the survey tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet", GIVEN[name])

    def _derived(self, name: str) -> DataFrame:
        source, columns = _SOURCES[name]
        texts = [f"{_dialect(text, spark=True)} AS `{alias}`" for alias, text in columns.items()]
        return self.raw(source).selectExpr(*texts)

    @cached_property
    def fish(self) -> DataFrame:
        return self._derived("sv_fish")

    @cached_property
    def log(self) -> DataFrame:
        return self._derived("sv_log")

    @cached_property
    def adult(self) -> DataFrame:
        return self._derived("sv_adult")

    @cached_property
    def visits(self) -> DataFrame:
        return self._derived("sv_visits")

    @cached_property
    def units(self) -> DataFrame:
        return self._derived("sv_units")

    @cached_property
    def trap(self) -> DataFrame:
        return self._derived("sv_trap")

    @cached_property
    def ages(self) -> DataFrame:
        return self._derived("sv_ages")

    @cached_property
    def stations(self) -> DataFrame:
        return self._derived("sv_stations")

    @cached_property
    def hydro(self) -> DataFrame:
        """Daily mean per station and parameter."""
        day = F.col("ts").cast("date").alias("date")
        return self.units.groupBy("station_number", day, "parameter").agg(F.avg("value").alias("value"))

    @cached_property
    def releases(self) -> DataFrame:
        rows = self.raw("orders").select(F.year("o_orderdate").alias("year"), "o_custkey")
        return rows.groupBy("year").agg((F.count_distinct("o_custkey") * 40).cast("double").alias("cwt_released"))

    @cached_property
    def wild(self) -> DataFrame:
        return canonical.canonical_fish(self.fish, WILD_SEASON)

    @cached_property
    def mixed(self) -> DataFrame:
        return canonical.canonical_fish(self.fish, MIXED_SEASON)

    @cached_property
    def overlaid(self) -> DataFrame:
        return self.fish.withColumn("overlay_date", dates.overlay_date("date"))
