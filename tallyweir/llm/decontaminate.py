"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is contained in a document only if each of its q-word shingles is. It is therefore
enough to join the shingle of the window that is rarest in the corpus: the necessary prefix of a full
containment has length one. The join yields a document, the place of the rare shingle and so the place
where the window would start; length and positional bounds drop windows that would start before the
text or end after it, and the survivors are compared word by word with the whole window.

Rarity is counted over all documents. The benchmark side is broadcast only after its rows have been
counted; a larger one is joined by shuffle, the document side then carrying only the words around a shingle.

Defined results: a null or empty text has no words, no hits and is not contaminated; items without words
(null included) have no windows; an item with a null id marks words but is not listed; repeated items and
repeated document rows count once per row; empty tables give empty or all-clean results; other columns are
ignored. Rows are told apart by id and a hash of the text, so rows with the same or a null id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweir.llm.text import ASCII_NON_WORD, ascii_lower, positions, whole, words

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
#: Rows of the benchmark side up to which it is broadcast (about 200 bytes each).
BROADCAST_ROWS = 200_000


def item_words(text: Column) -> Column:
    """Lower-case words of letters, digits and everything beyond ASCII."""
    return words(ascii_lower(whole(text)), ASCII_NON_WORD)


def windows(items: DataFrame, id_col: str = "item_id", text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """One row per item window: item_id, window (its words), q (words of its shingles)."""
    w = items.select(F.col(f"`{id_col}`").alias("item_id"), item_words(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)
    n = F.size("w") - (width - 1)
    at = F.explode(positions(F.greatest(n, F.lit(1)))).alias("at")
    return (
        w.select("item_id", "w", at)
        .select("item_id", F.slice("w", F.col("at") + 1, F.lit(width)).alias("window"))
        .distinct()
        .withColumn("q", F.least(F.size("window"), F.lit(SHINGLE_WORDS)))
    )


def _key(array: Column, at: Column, q: int) -> Column:
    return F.xxhash64(F.lit(q), *[F.get(array, at + k) for k in range(q)])


def _window_shingles(win: DataFrame) -> DataFrame:
    """One row per window and shingle: item_id, window, at (place in the window), key."""
    key = F.expr("NULL").cast("long")
    for q in range(1, SHINGLE_WORDS + 1):
        key = F.when(F.col("q") == q, _key(F.col("window"), F.col("at"), q)).otherwise(key)
    return (
        win.select("item_id", "window", "q", F.explode(positions(F.size("window") - F.col("q") + 1)).alias("at"))
        .withColumn("key", key)
    )


def _document_shingles(docs: DataFrame, sizes: list[int]) -> list[DataFrame]:
    """For each shingle size: doc, w (all words), at, key. The words stay a reference until a row survives the join."""
    split = docs.select("doc", "w")
    out = []
    for q in sizes:
        places = split.select("doc", "w", F.posexplode("w").alias("at", "first"))
        out.append(places.select("doc", "w", "at", _key(F.col("w"), F.col("at"), q).alias("key")).where(F.col("at") <= F.size("w") - q))
    return out


def hits(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = WINDOW_WORDS, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every occurrence of an item window in a document: doc, item_id, start (word), n (words)."""
    win = windows(items, item_id, item_text, width)
    sizes = sorted(r.q for r in win.select("q").distinct().collect())  # at most SHINGLE_WORDS values
    split = docs.select(F.col(f"`{doc_id}`").alias("doc"), item_words(F.col(f"`{text}`")).alias("w"))
    shingles = _window_shingles(win)
    small = shingles.count() <= broadcast_rows

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc {docs.schema[doc_id].dataType.simpleString()}, start int, n int").join(
            items.select(F.col(f"`{item_id}`").alias("item_id")).limit(0)
        ).select("doc", "item_id", "start", "n")

    found = _document_shingles(split, sizes)
    wanted = side(shingles.select("key").distinct())
    counts = None
    for part in found:
        seen = part.select("key").join(wanted, "key", "left_semi")
        counts = seen if counts is None else counts.unionAll(seen)
    rarity = counts.groupBy("key").agg(F.count(F.lit(1)).alias("n_seen"))
    # the rarest shingle of each window that the corpus has at all; a window with an unseen shingle occurs nowhere
    ranked = shingles.join(rarity, "key", "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
    by_rarity = Window.partitionBy("item_id", "window").orderBy("n_seen", "key", "at")
    prefix = (
        ranked.withColumn("rank", F.row_number().over(by_rarity))
        .where((F.col("rank") == 1) & (F.col("n_seen") > 0))
        .select("item_id", "window", "key", F.col("at").alias("inside"), F.size("window").alias("n"))
    )
    out = None
    for part in found:
        start, n = F.col("at") - F.col("inside"), F.col("n")
        if small:
            near = part.join(F.broadcast(prefix), "key").where((start >= 0) & (start + n <= F.size("w")))
            same = near.where(F.slice("w", F.greatest(start, F.lit(0)) + 1, n) == F.col("window"))
        else:
            first = F.greatest(F.col("at") - (width - 1), F.lit(0))
            around = part.select("doc", "at", "key", first.alias("first"), F.slice("w", first + 1, F.lit(2 * width)).alias("w"))
            near = around.join(prefix, "key").where((start >= F.col("first")) & (start + n <= F.col("first") + F.size("w")))
            same = near.where(F.slice("w", F.greatest(start - F.col("first"), F.lit(0)) + 1, n) == F.col("window"))
        part_hits = same.select("doc", "item_id", start.alias("start"), "n")
        out = part_hits if out is None else out.unionAll(part_hits)
    return out


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = WINDOW_WORDS, percent: int = 5, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per document: doc, text_hash (of the text, 64 bits), n_words, n_hit (words inside an occurrence), items (ids, sorted as text), contaminated.

    A document is contaminated if it has a hit and at least ``percent`` of its words are hit.
    """
    doc = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text"))
    rows = docs.select(doc.alias("doc"), F.col(f"`{text}`").alias("text"))
    marks = hits(rows, items, "doc", "text", item_id, item_text, width, broadcast_rows)
    # intervals of one document: repeated windows of many items meet in few distinct ones before anything is gathered
    spans = marks.groupBy("doc", "start").agg(F.max("n").alias("n"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    by_start = F.array_sort(F.collect_list(F.struct("start", "n")))
    ends = F.aggregate(
        by_start,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["total"] + F.greatest(x["start"] + x["n"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("total"),
            F.greatest(a["end"], x["start"] + x["n"]).alias("end"),
        ),
        lambda a: a["total"],
    )
    per_doc = spans.groupBy("doc").agg(
        ends.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items")
    )
    sized = rows.select("doc", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    joined = sized.join(per_doc.withColumnRenamed("doc", "hit_doc"), F.col("doc").eqNullSafe(F.col("hit_doc")), "left").drop("hit_doc")
    filled = joined.select(
        F.col("doc.id").alias("doc"), F.col("doc.text").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return filled.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
