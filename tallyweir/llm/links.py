"""Connected components of links, as DataFrame steps."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.session import ensure_checkpoint_dir

#: Files per core that a table of ids is written to at most.
FILES_PER_CORE = 2


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; cuts the lineage."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._stored_folder = folder
    return out


def stored_ids(df: DataFrame, name: str) -> DataFrame:
    """A table of ids, pairs or counts, ``stored`` in a few files per core at most, however many partitions it was made in.

    On a local file system without Hadoop's native library every file starts processes that show the executor's memory again.
    """
    return stored(df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism), name)


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the blocks of the executors' disks: no files, and its partitions stay as they are.

    The lineage stays too, so this is for a few large tables that are read more than once, not for the rounds of a loop.
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept


def forget(*tables: DataFrame) -> None:
    """Remove stored or held tables that nothing reads any more; everything derived from them must be stored or held itself."""
    for table in tables:
        if table.is_cached:
            table.unpersist()
            continue
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in a link (a, b); component is the smallest id reachable.

    Labels start as the smallest neighbour, then pass over the links and jump to the label of the label,
    so a chain of n links takes about log n rounds. Minima are combined in the map tasks, and a link table
    is joined rather than gathered per node, so a node with very many links is no group of its own.
    """
    both = stored_ids(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links"
    )
    table = stored_ids(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    labels = table
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("other")), "b")
            .groupBy("a").agg(F.min("other").alias("other"))
        )
        passed = labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.col("component").alias("was"), F.least("component", "other").alias("component")
        )
        roots = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = stored_ids(passed.join(roots, "component", "left").select("id", "was", F.coalesce(F.least("component", "root"), "component").alias("component")), "labels")
        changed = not jumped.where("was <> component").isEmpty()
        forget(table)
        labels, table = jumped.select("id", "component"), jumped
        if not changed:
            forget(both)
            return labels
