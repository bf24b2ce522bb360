"""Merkle manifest of a dataset: a tree per group of rows and one over the groups' roots.

Every row becomes a leaf, the SHA-256 of its fields; a null field is ``-``, any other its number of UTF-8 bytes, a
colon and the value. The leaves of a group stand in the order of a column. While a group has more than one node, every
``arity`` consecutive ones (the last run may be shorter, even one) become their SHA-256. The groups' roots, ordered by
group (null first, then by bytes), are the leaves of a last tree.

Each level is one step of equijoins: a node computes the indices of its siblings (``index XOR 1`` for two, slot
offsets inside the run otherwise) and joins the level with itself on (tree, index); the rows of slot zero, which have
seen their whole run, emit the parents. No group is gathered: the key of every join holds the index, so a group with a
third of all rows spreads like any other, and the places of the leaves come from a range sort with running counts per
partition. A level is written once to the shared folder, so lost executors cost one level at most. The way back joins
every node with its parent's path, so the work of all levels is ``arity / (arity - 1)`` times that of the leaves.

Defined results: nulls in any field are encoded, a null group is a group of its own; rows with equal order values stand
in the order of their leaves, so repeated rows have neighbouring places; an empty text is ``0:``; a group of one row has
its leaf as root; an empty table has no rows and no root; other columns and their names play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.llm.jaccard import few_rows
from tallyweir.llm.links import stored

PATH = "array<struct<before:string,after:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the encoded fields, as lowercase hex."""

    def encoded(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(encoded, fields)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path as one text, from the leaf upwards, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _numbered(leaves: DataFrame) -> DataFrame:
    """Columns index (place in the tree, from 0) and n (leaves of the tree) beside (row, tree, digest), for any size of tree."""
    spark = leaves.sparkSession
    order = ["tree", F.col("at").asc_nulls_first(), "digest", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the tie splits a run of equal rows; it can't change a digest
    placed = stored(
        leaves.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("row", "tree", "digest", F.spark_partition_id().alias("part"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")),
        "leaves",
    )
    # at most one row per tree and one more per partition
    runs = stored(placed.groupBy("part", "tree").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("m")), "runs")
    same = Window.partitionBy("tree")
    before = F.sum("m").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select("part", "tree", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(same).alias("n"))
    return placed.join(few_rows(stored(offsets, "offsets")), ["part", "tree"]).select(
        "row", "tree", (F.col("pos") + F.col("shift")).alias("index"), "n", "digest"
    )


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """The nodes of one level with the digests of the run's others: ``before`` and ``after`` the own slot, left to right."""
    slot = F.col("index") % arity
    others = nodes.where("n > 1").select(F.col("tree").alias("tree_"), F.col("index").alias("index_"), F.col("digest").alias("digest_"))
    out = nodes
    for shift in range(1, arity):
        index = F.col("index").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("index") - slot + (slot + shift) % arity
        found = others.select("tree_", "index_", F.col("digest_").alias(f"other_{shift}"))
        out = out.join(found, (F.col("tree") == F.col("tree_")) & (index == F.col("index_")), "left").drop("tree_", "index_")

    def at(place: int) -> Column:
        """The sibling in this slot of the run; null in the own slot and where the run ends."""
        return F.coalesce(*[F.when((slot + shift) % arity == place, F.col(f"other_{shift}")) for shift in range(1, arity)])

    before = F.concat_ws("", *[F.when(slot > place, at(place)) for place in range(arity)])
    after = F.concat_ws("", *[F.when(slot < place, at(place)) for place in range(arity)])
    return out.withColumns({"before": before, "after": after}).drop(*[f"other_{shift}" for shift in range(1, arity)])


def _climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The stored levels from the leaves up. A tree's last row is that with n = 1, its root."""
    top = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while top > 1:
        level = stored(_with_siblings(nodes, arity), f"level-{len(levels)}")
        levels.append(level)
        index, n = (F.col("index") / arity).cast("long"), F.ceil(F.col("n") / arity)
        nodes = level.where(f"n > 1 AND index % {arity} = 0").select(
            "tree", index.alias("index"), n.alias("n"), F.sha2(F.concat("digest", "after"), 256).alias("digest")
        )
        top = -(-top // arity)
    last = nodes.withColumns({"before": F.lit(""), "after": F.lit("")})
    return [*levels, stored(last, f"level-{len(levels)}")]


def _descend(levels: list[DataFrame], roots: DataFrame, arity: int) -> DataFrame:
    """The leaves with the subroot of their tree and their path up to the root; ``roots`` are (tree, subroot, path)."""
    above = None
    for level in reversed(levels):
        here = level.where("n = 1").join(roots, "tree")
        if above is not None:
            step = F.array(F.struct("before", "after"))
            up = above.select(F.col("tree").alias("tree_"), F.col("index").alias("index_"), "subroot", F.col("path").alias("up"))
            parent = (F.col("tree") == F.col("tree_")) & ((F.col("index") / arity).cast("long") == F.col("index_"))
            inner = level.where("n > 1").join(up, parent).withColumn("path", F.concat(step, "up"))
            here = inner.select(*here.columns).unionByName(here)
        above = here
    return above


def manifest(
    docs: DataFrame, fields: Sequence[Column], group: Column, order: Column, kept: Sequence[Column], arity: int = 3
) -> tuple[DataFrame, str | None]:
    """(rows, root): per row of ``docs`` (row: a struct of the ``kept`` columns, leaf, subroot, path), and the root of all.

    ``path`` lists, from the leaf's level to the root, the digests before and after the own one in its run.
    """
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # '' is the null group and sorts first
    leaves = docs.select(F.struct(*kept).alias("row"), tree.alias("tree"), order.alias("at"), leaf_digest(*fields).alias("digest"))
    levels = _climb(_numbered(leaves), arity)
    tops = reduce(DataFrame.unionByName, [level.where("n = 1").select("tree", "digest") for level in levels])
    # a root's path leads through the tree of the roots; the tree is carried along as its row
    entries = tops.select(F.struct("tree").alias("row"), F.lit("").alias("tree"), F.col("tree").alias("at"), "digest")
    upper = _climb(_numbered(entries), arity)
    root = upper[-1].select("digest").first()
    end = upper[-1].select("tree", F.col("digest").alias("subroot"), F.array().cast(PATH).alias("path"))
    ways = _descend(upper, end, arity).select("row.tree", F.col("digest").alias("subroot"), "path")
    rows = _descend(levels, stored(ways, "ways"), arity).select("row", F.col("digest").alias("leaf"), "subroot", "path")
    return rows, root[0] if root else None
