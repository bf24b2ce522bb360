"""Query registry: name -> Spark function, SQL twin, inventory items covered."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from catalog.tables import SQL, Tables

REGISTRY: dict[str, Query] = {}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


def query(covers: str, sql: str | None = None):
    """Register the decorated function under its name. ``covers`` lists inventory items."""

    def add(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"{fn.__name__} is registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, fn, with_tables(sql), tuple(covers.split()))
        return fn

    return add


def with_tables(sql: str | None) -> str | None:
    """Put the definitions of the survey tables a statement uses in front of it."""
    if sql is None:
        return None
    body = sql.strip()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bsv_[a-z0-9_]+", text):
            if name in SQL and name not in needed:
                visit(SQL[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    defs = ",\n".join(f"{name} AS ({SQL[name].strip()})" for name in needed)
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, flags=re.IGNORECASE)
    return f"{match.group()}{defs},\n{body[match.end():]}" if match else f"WITH {defs}\n{body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a parallel sum does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
