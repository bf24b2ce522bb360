"""Files that the search for near duplicates writes for itself."""

from __future__ import annotations

from tallyweir.llm import jaccard, links

PARTITIONS = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_files_follow_the_cores_and_not_the_partitions(spark, monkeypatch):
    files = []
    plain = links.stored

    def watched(df, name):
        out = plain(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    for module in (links, jaccard):
        monkeypatch.setattr(module, "stored", watched)
    # near copies in chains, so that every table has rows in most partitions
    rows = [(i, " ".join(f"{i // 3}-{k}" for k in range(i % 3, 60))) for i in range(900)]
    cores = spark.sparkContext.defaultParallelism
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(cores)
    before = {k: spark.conf.get(k) for k in PARTITIONS}
    blocks = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    try:
        for k, v in PARTITIONS.items():
            spark.conf.set(k, v)
        found = jaccard.jaccard_components(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: r.component_id for r in found} == {i: i - i % 3 for i, _ in rows}
    assert {"links", "labels", "candidates", "found"} <= {name for name, _ in files}
    assert all(n <= links.FILES_PER_CORE * cores < 40 for _, n in files), files
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == blocks
