"""The two seasons' own rules and the fixed schemas, on literal sheets."""

from __future__ import annotations

import datetime as dt

import pytest

from tallyweir.plans import canonical
from tallyweir.sources import readers, schemas, writers

DAY = dt.date(2025, 6, 18)


def sheet(spark, rows):
    names = schemas.INDIVIDUAL_FISH.fieldNames()
    base = dict.fromkeys(names) | {"year": 2025, "date": DAY, "site": "fence", "species": "co-w", "count": 1.0}
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], schemas.INDIVIDUAL_FISH)


def test_season_of_2024(spark):
    rows = [
        {"row_label": 1, "size_cwt": "big", "a_adclip": "yes", "fork_length_mm": 100.0, "weight_g": 10.0},
        {"row_label": 2, "size_cwt": None, "a_adclip": "yes", "sacrifice": "yes", "mort": "yes"},
        {"row_label": 3, "size_cwt": "biggest", "r_adclip": "yes", "mort": "yes"},
        {"row_label": 4, "size_cwt": "huge"}, {"row_label": 5, "species": "co-a", "size_cwt": "big"},
    ]
    out = {r.row_label: r for r in canonical.canonical_fish(sheet(spark, rows), canonical.SEASON_2024).collect()}
    assert {k: (r.fate, r.tag_status, r.release_site) for k, r in out.items()} == {
        1: ("live", "A", "fence"), 2: ("sacrifice", None, "fence"), 3: ("mort", "R", "fence"),
    }
    assert out[1].k == pytest.approx(1.0) and (out[1].iso_week, out[1].year_day, out[1].week) == (25, 169, dt.date(2025, 6, 16))


def test_season_of_2025(spark):
    late = DAY + dt.timedelta(days=1)
    rows = [
        {"row_label": 1, "size_cwt": "S", "a_caudalclip": "top", "a_adclip": "yes", "date": late},
        {"row_label": 2, "size_cwt": "M", "a_caudalclip": "bottom", "a_adclip": "yes"},
        {"row_label": 3, "size_cwt": "L", "species": "co-a", "r_caudalclip": "none", "r_adclip": "yes"},
        {"row_label": 4, "size_cwt": "Unknown", "species": "co-a", "r_caudalclip": "bottom", "r_adclip": "yes"},
        {"row_label": 5, "size_cwt": "big"}, {"row_label": 6, "size_cwt": None, "species": "ct", "date": late},
    ]
    fish = canonical.canonical_fish(sheet(spark, rows), canonical.SEASON_2025)
    out = {r.row_label: (r.species, r.release_site, r.tag_status) for r in fish.collect()}
    assert out == {
        1: ("co-w", "barn", "A"), 2: ("co-w", "fence", "A"), 3: ("co-h", "fence", "R"), 4: ("co-w.r", "fence", "R"), 6: ("ct", "fence", None),
    }
    assert {r.row_label for r in canonical.wild(fish).collect()} == {1, 2, 4}


@pytest.mark.parametrize("name", ["INDIVIDUAL_FISH", "TAG_LOG", "TRAP_EFFORT", "ADULT_FISH", "ADULT_EFFORT", "DAILY_HYDRO", "STATIONS", "YEAR_RELEASES", "AGES"])
def test_tables_keep_their_schema_through_text(spark, tmp_path, name):
    schema = getattr(schemas, name)
    values = {"int": 3, "bigint": 4, "double": 2.5, "string": "x, y", "boolean": True, "date": DAY, "timestamp_ntz": dt.datetime(2025, 6, 18, 9, 30)}
    full = tuple(values[f.dataType.simpleString()] for f in schema)
    rows = [full, (full[0], *[None] * (len(full) - 1))]
    path = str(tmp_path / name)
    writers.write_csv(spark.createDataFrame(rows, schema), path)
    back = readers.read_csv(spark, path, schema)
    assert back.schema == schema and sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
