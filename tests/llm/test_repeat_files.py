"""Files that the removal of repeated strings writes for itself."""

from __future__ import annotations

from tallyweir.llm import links, repeats


def test_phrases_are_written_to_one_file_per_partition(spark, monkeypatch):
    files = {}

    def watched(df, name):
        out = links.stored(df, name)
        files[name] = out.inputFiles()
        return out

    monkeypatch.setattr(repeats, "stored", watched)
    rows = [(i, " ".join(f"{(i * 7 + k) % 90}-{k}" for k in range(200))) for i in range(360)]
    found = repeats.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 360 and all(r.n_bytes == len(t) and [(x["first"], x["end"]) for x in r.removed] == [(0, len(t))] for r, (_, t) in zip(sorted(found), rows, strict=True))
    assert 1 < len(files["phrases"]) <= max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
