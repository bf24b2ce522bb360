"""Every query against its SQL twin, and the inventory it must cover."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from catalog import REGISTRY
from catalog.tables import Tables
from tests.oracle import compare, connect, plan

FITS = {"candidate_fit_shapes", "one_pool_fit", "candidate_stratified_fits", "ranked_models"}

SIZES = dict(SRC=9, SNK=2, PRJ=11, FLT=9, JOI=10, AGG=23, WIN=6, SRT=6, SET=3, RSH=4, SCL=20, DOM=33, MOD=10)
ITEMS = [f"{kind}-{i:02d}" for kind, n in SIZES.items() for i in range(1, n + 1)] + [f"P{i:02d}" for i in range(1, 54)]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_agrees_with_sql(spark, folder, con, name):
    query = REGISTRY[name]
    df = query.run(Tables(spark, folder))
    if query.sql is None:
        assert df.collect()
    else:
        assert compare(df, con, query.sql) == []
    # no plan pairs all rows of two sides; Python runs only in the fits (and for p-values, in batches)
    shown = plan(df)
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown and "BatchEvalPython" not in shown
    assert "FlatMapGroupsInPandas" not in shown or name in FITS


def test_every_inventory_item_is_covered():
    covered = {item for q in REGISTRY.values() for item in q.covers}
    assert [item for item in ITEMS if item not in covered] == []
    assert covered <= set(ITEMS)


def test_contract(spark, folder):
    names = set(contract.queries())
    assert set(REGISTRY) <= names and {n for n in names - set(REGISTRY) if not n.startswith("op")} <= {"pipeline"}
    assert set(contract.oracle_sql()) <= names
    assert {n for n in REGISTRY if n not in contract.oracle_sql()} == {"candidate_stratified_fits", "ranked_models"}
    assert contract.entry(spark).count() > 0
