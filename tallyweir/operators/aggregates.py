"""Aggregates that need more than one Spark call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.missing import n_rows, ratio
from tallyweir.operators.joins import small_side
from tallyweir.session import materialise

# Size of the quantile sketch of a group, and a multiple of its rank error: the band around a wanted rank that pass two reads.
# At this size the stated error is about 0.07 % of the ranks (99 % confidence); a miss is seen and answered exactly.
SKETCH_SIZE, RANK_BAND = 8_192, 0.003


def first_by(x: str, order: str | Column) -> Column:
    return F.min_by(x, order)


def last_by(x: str, order: str | Column) -> Column:
    return F.max_by(x, order)


def distinct_text(x: str | Column, separator: str = ",") -> Column:
    """Distinct known values, sorted and joined; empty text when there are none.

    For tables reduced to few rows per group; see :func:`distinct_text_by` for observations.
    """
    return F.array_join(F.array_sort(F.collect_set(x)), separator)


def distinct_text_by(df: DataFrame, keys: Sequence[str], x: str, name: str, separator: str = ",") -> DataFrame:
    """Distinct values of each group as text. Repeats are removed by hash before sets are collected."""
    return df.select(*keys, x).distinct().groupBy(*keys).agg(distinct_text(x, separator).alias(name))


def shares(df: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Each row's share of its group's total, for tables that are aggregated already."""
    total = F.sum(value).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return df.withColumn(name, ratio(value, total))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts per cell with row total and share within the row; rows with a missing factor are left out."""
    cells = (
        df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row, column).agg(n_rows().alias("n"))
    )
    by_row = Window.partitionBy(row)
    return cells.withColumn("row_total", F.sum("n").over(by_row)).withColumn("share", ratio("n", "row_total"))


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Type, known count, distinct count, smallest and largest value of every column.

    One pass; the distinct counts are approximate (``n_distinct_approx``), everything else is exact. With
    ``exact`` they are exact too (``n_distinct``), for a shuffle of the distinct values of every column.
    """
    distinct = (F.count_distinct, "n_distinct") if exact else (F.approx_count_distinct, "n_distinct_approx")
    measures = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        measures.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.count(c).alias("n_known"),
                (n_rows() - F.count(c)).alias("n_missing"),
                distinct[0](c).alias(distinct[1]),
                F.min(c).cast("string").alias("smallest"),
                F.max(c).cast("string").alias("largest"),
            )
        )
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def _same(left: Sequence[str], right: str) -> Column:
    match = F.lit(True)
    for j, k in enumerate(left):
        match = match & F.col(k).eqNullSafe(F.col(f"{right}{j}"))
    return match


def quantile_sketches(df: DataFrame, value: str, keys: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """Per group: n, least and largest value and a mergeable sketch of the values (missing ones and NaN left out).

    Sketches of days or parts can be stored and merged later (``kll_merge_agg_double``) without the rows.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    measures = [n_rows().alias("n"), F.min("_v").alias("least"), F.max("_v").alias("largest"), F.kll_sketch_agg_double("_v", F.lit(size)).alias("sketch")]
    return rows.groupBy(*keys).agg(*measures)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    size: int = SKETCH_SIZE,
    band: float = RANK_BAND,
) -> DataFrame:
    """Exact linearly interpolated quantiles in two scans, without bringing a group together.

    Scan one keeps a mergeable sketch per group, which brackets every wanted rank by two values. Scan two counts the
    rows below a bracket and the equal values inside it, both combined in the map tasks, and picks the order
    statistics. A group of few rows has its whole range as bracket. Should a bracket miss its rank, the group is read once
    more with the whole range. Returns the keys, ``n`` and one column ``q<i>`` per probability.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    few = F.col("n") * band <= 2

    def at(rank: float, edge: str) -> Column:
        return F.when(few, F.col(edge)).otherwise(F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(rank, 0.0), 1.0))))

    brackets = []
    for i, p in enumerate(probabilities):
        place = (F.col("n") - 1) * F.lit(float(p))
        low = F.col("least") if p - band <= 0 else at(p - band, "least")
        high = F.col("largest") if p + band >= 1 else at(p + band, "largest")
        brackets.append(F.struct(
            F.lit(i).alias("i"), F.floor(place).alias("k"), (place - F.floor(place)).alias("f"), low.alias("lo"), high.alias("hi"),
        ))
    groups = quantile_sketches(df, value, keys, size).where("n > 0").select(*keys, "n", "least", "largest", F.array(*brackets).alias("_b"))
    groups = small_side(groups)
    picked = materialise(_order_statistics(rows, groups, keys, len(brackets)))  # a row per group and probability
    missed = small_side(picked.where("NOT _held").select(*keys).distinct())
    if not missed.isEmpty():
        whole = F.transform("_b", lambda b: b.withField("lo", F.col("least")).withField("hi", F.col("largest")))
        again = _semi(groups, missed, keys).withColumn("_b", whole)
        picked = _anti(picked, missed, keys).unionByName(_order_statistics(rows, again, keys, len(brackets)))
    columns = [F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probabilities))]
    return picked.groupBy(*keys, "n").agg(*columns)


def _keyed(df: DataFrame, keys: Sequence[str], right: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{right}{j}" for j, k in enumerate(keys)})


def _semi(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(_keyed(chosen, keys, "_c"), _same(keys, "_c"), "left_semi")


def _anti(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(_keyed(chosen, keys, "_c"), _same(keys, "_c"), "left_anti")


def _order_statistics(rows: DataFrame, groups: DataFrame, keys: Sequence[str], n_brackets: int) -> DataFrame:
    """Per group and bracket: n, _i, _q (the interpolated value) and _held, whether both ranks lie in the bracket."""
    edges = {f"_{edge}{i}": F.get("_b", F.lit(i))[edge] for i in range(n_brackets) for edge in ("lo", "hi")}
    near = rows.join(_keyed(groups.select(*keys, *[c.alias(name) for name, c in edges.items()]), keys, "_g"), _same(keys, "_g"))
    # where a row stands to every bracket, as digits below (0), inside (1) and above (2); only rows inside one keep their value
    v, code, hit = F.col("_v"), F.lit(0).cast("long"), F.lit(False)
    for i in range(n_brackets):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        code = code + F.when(v < low, 0).when(v <= high, 1).otherwise(2) * F.lit(3**i).cast("long")
        hit = hit | v.between(low, high)
    first = near.groupBy(*keys, code.alias("_code"), F.when(hit, v).alias("_x")).agg(n_rows().alias("_c"))
    digits = [F.pmod(F.floor(F.col("_code") / 3**i), F.lit(3)) for i in range(n_brackets)]
    seen = [F.when(d < 2, F.struct(F.lit(i).alias("_i"), F.when(d == 1, F.col("_x")).alias("_x"))) for i, d in enumerate(digits)]
    each = first.select(*keys, "_c", F.inline(F.array_compact(F.array(*seen))))
    counts = each.groupBy(*keys, "_i", "_x").agg(F.sum("_c").alias("_c"))
    inside = Window.partitionBy(*keys, "_i").orderBy(F.col("_x").asc_nulls_first())
    to = F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("_to", to).where("_x IS NOT NULL")
    wanted = _keyed(groups.select(*keys, "n", F.explode("_b").alias("_b")), keys, "_g").select(
        *[f"_g{j}" for j in range(len(keys))], "n", F.col("_b.i").alias("_at"), F.col("_b.k").alias("_k"), F.col("_b.f").alias("_f"))
    ranked = wanted.join(placed, _same(keys, "_g") & (F.col("_at") == F.col("_i")), "left")
    above, start = F.least(F.col("_k") + 1, F.col("n") - 1), F.col("_to") - F.col("_c")
    low = F.max(F.when((start <= F.col("_k")) & (F.col("_k") < F.col("_to")), F.col("_x")))
    high = F.max(F.when((start <= above) & (above < F.col("_to")), F.col("_x")))
    both = ranked.groupBy(*[F.col(f"_g{j}").alias(k) for j, k in enumerate(keys)], "n", F.col("_at").alias("_i")).agg(
        low.alias("_low"), high.alias("_high"), F.max("_f").alias("_f"))
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
        F.col("_low") + F.when(F.col("_f") > 0, F.col("_f") * (F.col("_high") - F.col("_low"))).otherwise(F.lit(0.0))
    )
    return both.withColumn("_q", between).withColumn("_held", F.col("_low").isNotNull() & F.col("_high").isNotNull())

