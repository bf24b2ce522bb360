"""Run a query and its SQL twin on the same folder and compare schema and values."""

from __future__ import annotations

import io
import math
import os
from contextlib import redirect_stdout

import duckdb

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SAME_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plan(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return (2, "nan")
        return (3, repr(value + 0.0 if value else 0.0))
    if isinstance(value, int):
        return (4, str(value))
    return (5, str(value))


def compare(df, con, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree exactly."""
    names = df.columns
    result = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in result.description}
    sql_rows = result.fetchall()
    order = list(sql_types)
    if sorted(names) != sorted(order):
        return [f"columns differ: {sorted(names)} against {sorted(order)}"]
    problems = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if SAME_TYPE.get(kind, kind) != sql_types[field.name]:
            problems.append(f"type of {field.name}: {kind} against {sql_types[field.name]}")
    shared = sorted(names)
    mine = sorted(tuple(_cell(row[n]) for n in shared) for row in df.collect())
    at = [order.index(n) for n in shared]
    theirs = sorted(tuple(_cell(row[i]) for i in at) for row in sql_rows)
    if len(mine) != len(theirs):
        problems.append(f"rows: {len(mine)} against {len(theirs)}")
    if mine != theirs:
        left, right = set(mine), set(theirs)
        only_mine, only_theirs = sorted(left - right)[:2], sorted(right - left)[:2]
        problems.append(f"values in {shared}: only Spark {only_mine}, only SQL {only_theirs}")
    if not mine:
        problems.append("no rows")
    return problems
