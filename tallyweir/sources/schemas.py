"""One fixed schema per table."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def table(columns: str) -> T.StructType:
    """Schema from ``name TYPE, ...`` without needing a running session."""
    pairs = [part.split() for part in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in pairs])


INDIVIDUAL_FISH = table(
    "year INT, date DATE, site STRING, species STRING, count DOUBLE, size_cwt STRING, mort STRING, "
    "sacrifice STRING, a_adclip STRING, r_adclip STRING, a_caudalclip STRING, r_caudalclip STRING, "
    "tag_code STRING, head_mold_size STRING, fork_length_mm DOUBLE, weight_g DOUBLE, gr_age STRING, "
    "row_label BIGINT, scale_number BIGINT"
)

TAG_LOG = table(
    "tag_date DATE, tag_code STRING, head_mold_size STRING, inj_n DOUBLE, mort_n DOUBLE, "
    "sacrifice_n DOUBLE, r_check_date DATE, r_retention_n DOUBLE, r_sample_size DOUBLE, r_re_tagged_n DOUBLE"
)

TRAP_EFFORT = table(
    "date DATE, site STRING, type STRING, arrival_time_24h TIMESTAMP_NTZ, departure_time_24h TIMESTAMP_NTZ, "
    "water_level_m DOUBLE, water_temp_c DOUBLE"
)

ADULT_FISH = table(
    "year INT, date DATE, time_of_day STRING, total DOUBLE, species STRING, mark_gender STRING, "
    "recap_tag_colour STRING, broodstock BOOLEAN, scale_book BIGINT, fork_length_mm DOUBLE"
)

ADULT_EFFORT = table(
    "year INT, date DATE, time_of_day STRING, arrival_time TIMESTAMP_NTZ, departure_time TIMESTAMP_NTZ"
)

DAILY_HYDRO = table("station_number STRING, date DATE, parameter STRING, value DOUBLE")

UNIT_VALUES = table(
    "Date STRING, Parameter STRING, Value DOUBLE, Approval STRING, Qualifier STRING"
)

STATIONS = table("station_number STRING, station_name STRING, region STRING")

YEAR_RELEASES = table("year INT, cwt_released DOUBLE")

AGES = table(
    "gr_age STRING, eu_age STRING, age_code STRING, address STRING, sp STRING, source STRING, "
    "life_stage STRING, start_date DATE, end_date DATE, label STRING"
)
