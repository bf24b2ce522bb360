"""Joins in which a NULL key matches a NULL key.

No side is broadcast on faith. Typed-in lookup tables are checked when they are made; any other
small side goes through :func:`small_side`, which counts it first; everything else is left to
runtime statistics, which also split a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.session import materialise
from tallyweir.sources.readers import MAX_LITERAL_ROWS

#: Pieces of heavy keys for each shuffle partition, so that what falls to the tasks evens out.
PIECES = 4
#: Rows of one key from a side that a task can hold.
PART_ROWS = 1_000_000


def small_side(df: DataFrame, max_rows: int = MAX_LITERAL_ROWS) -> DataFrame:
    """``df`` written once, and hinted for broadcast only when it is counted to be small."""
    stored = materialise(df)
    few = stored.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(stored) if few else stored


def _match(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool) -> Column:
    pairs = [
        left[k].eqNullSafe(right[f"_r_{k}"]) if null_safe else left[k] == right[f"_r_{k}"] for k in on
    ]
    return reduce(lambda a, b: a & b, pairs)


def _renamed(right: DataFrame, on: Sequence[str]) -> DataFrame:
    return right.withColumnsRenamed({k: f"_r_{k}" for k in on})


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = True) -> DataFrame:
    """All rows of ``left`` with the columns of ``right`` where the keys agree."""
    other = _renamed(right, on)
    joined = left.join(other, _match(left, other, on, null_safe), "left")
    return joined.drop(*[f"_r_{k}" for k in on])


def inner_join(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = True) -> DataFrame:
    other = _renamed(right, on)
    joined = left.join(other, _match(left, other, on, null_safe), "inner")
    return joined.drop(*[f"_r_{k}" for k in on])


def full_join(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Rows of both sides; each key column is filled from whichever side has it.

    A full join cannot be split at a hot key, so both sides should be aggregated to the keys first
    (as the analyses here do), or joined by :func:`skew_safe_full_join`.
    """
    other = _renamed(right, on)
    joined = left.join(other, _match(left, other, on, null_safe), "full")
    keys = [F.coalesce(left[k], other[f"_r_{k}"]).alias(k) for k in on]
    rest = [left[c] for c in left.columns if c not in on]
    return joined.select(*keys, *rest, *[other[c] for c in right.columns if c not in on])


def skew_safe_full_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = True, most_rows: int = 1_000_000
) -> DataFrame:
    """:func:`full_join` in which the rows of a key with over ``most_rows`` rows on either side are dealt to many tasks.

    Spark can't split a full join at a hot key. Heavy keys are found by a count; the rows of one that both sides have are
    dealt to parts of about ``most_rows`` rows, and each part meets all parts of the other side. Every row is written once
    for each part of the other side, so a key is cut into no more pieces (pairs of parts) than its share, by rows read and
    made, of ``PIECES`` for each shuffle partition: more would let no task read less. No part has over ``PART_ROWS`` rows
    by that. A heavy key that one side lacks needs no join, all others meet in a plain full join.
    """
    known = [f"_k{j}" for j in range(len(on))]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sized(df: DataFrame, name: str) -> DataFrame:
        zero = {"_left": F.lit(0).cast("long"), "_right": F.lit(0).cast("long")}
        counts = df.groupBy(*[F.col(k).alias(a) for a, k in zip(known, on, strict=True)]).agg(F.count(F.lit(1)).alias(name))
        return counts.withColumns({c: v for c, v in zero.items() if c != name})

    sizes = sized(left, "_left").unionByName(sized(right, "_right")).groupBy(*known).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    meets = reduce(lambda a, b: a & b, [F.col(k).isNotNull() | null_safe for k in known], F.least("_left", "_right") > 0)
    heavy = small_side(sizes.where(F.greatest("_left", "_right") > most_rows).withColumns({"_meets": meets, "_pk": F.monotonically_increasing_id()}))

    made, read = F.col("_left").cast("double") * F.col("_right"), F.col("_left") + F.col("_right")
    all_made, all_read = heavy.where("_meets").agg(F.sum(made), F.sum(read)).first()
    pieces = PIECES * tasks * F.greatest(made / (all_made or 1), read / (all_read or 1))

    def parts(rows: str, wanted: Column) -> Column:
        """At most parts of ``most_rows`` rows, at least parts that a task can hold."""
        return F.greatest(F.least(F.ceil(F.col(rows) / most_rows), F.ceil(wanted)), F.ceil(F.col(rows) / max(most_rows, PART_ROWS)), F.lit(1)).cast("int")

    # the fewest copies are written when both sides' parts have as many rows
    even = F.least(pieces, F.sqrt(pieces * F.col("_left") / F.greatest("_right", F.lit(1))))
    cut = heavy.where("_meets").withColumn("_nl", parts("_left", F.floor(even))).withColumn("_nr", parts("_right", pieces / F.col("_nl")))
    cut = cut.withColumn("_nl", parts("_left", pieces / F.col("_nr"))).select(*known, "_pk", "_nl", "_nr")

    def of(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return df.join(some, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(a)) for a, k in zip(known, on, strict=True)]), how)

    spot = ["_pk", "_pl", "_pr"]

    def dealt(df: DataFrame, columns: Sequence[str], own: str, other: str) -> DataFrame:
        """The rows of heavy keys with ``_p{own}``, their own part, and a copy for every part of the other side in ``_p{other}``."""
        out = of(df, cut, "inner").withColumn(f"_p{own}", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(f"_n{own}")).cast("int"))
        out = out.withColumn(f"_p{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)))
        return out.select(*columns, *spot).repartition(tasks, *spot)  # by number: what a task makes doesn't show in the bytes it reads

    rest = [c for c in right.columns if c not in on]
    matched = dealt(left, left.columns, "l", "r").join(dealt(right, rest, "r", "l"), spot).drop(*spot)
    keys, alone = heavy.select(*known), heavy.where("NOT _meets").select(*known)
    light = full_join(of(left, keys, "left_anti"), of(right, keys, "left_anti"), on, null_safe)
    return (
        matched.unionByName(light).unionByName(of(left, alone, "left_semi"), allowMissingColumns=True).unionByName(of(right, alone, "left_semi"), allowMissingColumns=True)
        .select(*on, *[c for c in left.columns if c not in on], *rest)
    )


def in_window_table(
    rows: DataFrame, windows: DataFrame, date: str, keys: Sequence[str] = (), first: str = "first", last: str = "last", days: int = 32
) -> DataFrame:
    """Rows whose date lies in one of the inclusive windows of their key (stock, year, site), each row once.

    Windows are a table of any size: each is listed under the stretches of ``days`` days that it touches, so the join has
    equal keys and no chain of conditions. Windows without a bound, or that end before they begin, hold no date.
    """
    stretch = F.floor(F.unix_date(F.col("_first")) / days), F.floor(F.unix_date(F.col("_last")) / days)
    spans = windows.select(*[F.col(k).alias(f"_w{j}") for j, k in enumerate(keys)], F.col(first).cast("date").alias("_first"), F.col(last).cast("date").alias("_last"))
    spans = spans.where("_first <= _last").distinct().withColumn("_stretch", F.explode(F.sequence(*stretch)))
    dated = rows.withColumn("_at", F.floor(F.unix_date(F.col(date).cast("date")) / days))
    match = (F.col("_at") == F.col("_stretch")) & F.col(date).cast("date").between(F.col("_first"), F.col("_last"))
    for j, k in enumerate(keys):
        match = match & (F.col(k) == F.col(f"_w{j}"))
    return dated.join(spans, match, "left_semi").drop("_at")


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    other = _renamed(right.select(*on), on)
    return left.join(other, _match(left, other, on, null_safe), "left_anti")


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns the two sides share, in the order of ``left``: the keys of a natural join."""
    return [c for c in left.columns if c in right.columns]


def calendar_fill(days: DataFrame, counts: DataFrame, on: str = "date") -> DataFrame:
    """One row per calendar date, with NULL measures where nothing was counted.

    ``counts`` holds one row per date and class, i.e. it is aggregated before it gets here.
    """
    return left_join(days, counts, [on], null_safe=False)


def align_series(
    a: DataFrame, b: DataFrame, on: Sequence[str], scale: dict[str, float] | None = None,
    shift: dict[str, float] | None = None,
) -> DataFrame:
    """Two daily series side by side; named columns are rescaled (times, then plus)."""
    out = full_join(a, b, on, null_safe=False)
    for name, factor in (scale or {}).items():
        out = out.withColumn(name, F.col(name) * F.lit(float(factor)))
    for name, amount in (shift or {}).items():
        out = out.withColumn(name, F.col(name) + F.lit(float(amount)))
    return out
