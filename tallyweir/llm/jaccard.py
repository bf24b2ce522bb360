"""N-gram Jaccard join by T-occurrence search.

Two documents link when their sets of word 5-grams have a Jaccard similarity of at least a threshold.
A query set of size q and a candidate of size c link when they share T = ceil(t / (1 + t) * (q + c)) grams,
so a candidate must occur T times in the inverted lists of the query's grams.

1. Documents with equal sets form a class; only one document of a class goes on (``classes``).
2. Grams are ordered by rarity, the count of all documents' grams by hash bucket (a table of fixed size).
   The short lists are those of the rarest grams: two linked sets share a gram among the n - ceil(t n) + 1
   rarest of each. Lists with one document are dropped; grams of frequent buckets are never gathered in one
   task. The long lists are never built: documents are probed for their grams instead.
3. Every document of a short list is compared with one head of the list, which finds most links with one
   candidate per document and list, however long the list. Lists whose documents are then still in different
   components take other heads in turn, and at last give all remaining candidates, pairs across components
   only. A pair must meet in a list at ranks that leave room for the overlap it needs, and share as many
   short lists as linked sets do at least (``_sharing``), before whole texts are fetched for it.
4. Candidates of one query are searched by DivideSkip in blocks of bounded size (``t_occurrence``): the
   short lists of the block are heap-merged, the long ones probed by binary search.

Components need no link inside a component, so none is lost that joins two of them. Defined results: a null
or blank text has no gram, links with nothing and is its own component; fewer than five words are one gram;
every row gives a row. Rows are told apart by their id; where ids repeat or are null (``ids_differ``, an
aggregate over the ids), by a hash of id and text (``row_key``), so that different texts of one id are different documents and equal
rows are one. A row without id takes the smallest id of its component, null if there is none. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.links import components, forget, held, stored, stored_ids

NGRAM = 5
PERCENT = 75
#: Entries of the rarity table: a fixed size whatever the corpus; one of 4 bytes each is sent to every task.
BUCKETS = 1 << 20
#: Grams that a task holds before it passes them on.
HELD_GRAMS = 400_000
#: Texts that a task turns into grams at a time.
HELD_TEXTS = 256
#: Candidates that are searched together.
BLOCK = 256
#: Turns with other heads, before documents of different components are compared with all they meet.
EXTRA_HEADS = 1
#: Rows of a pair or id table up to which it is broadcast (16 to 24 bytes each); a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], dtype=np.uint64)


#: A-Z as a-z, and ASCII white space as a blank.
_LOWERED = bytes(32 if k in b"\t\n\v\f\r " else k + 32 if 65 <= k <= 90 else k for k in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def grams(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams; of the whole text if it has fewer words."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    width = min(n, len(h))
    return np.unique(_windows(_mixed(h), width))


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` consecutive words, from the words' mixed hashes."""
    with np.errstate(over="ignore"):
        total = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            total += h[k : len(h) - width + 1 + k] * _MULTIPLIERS[k]
    return _mixed(total)


def gram_sets(texts: pa.Array, n: int = NGRAM) -> list[np.ndarray]:
    """:func:`grams` of every text: words are found in the bytes of all texts at once, and each distinct word is hashed once."""
    import xxhash

    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return []
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    low, high = int(bounds[0]), int(bounds[-1])
    raw = bytes(data[low:high]).translate(_LOWERED) if high > low else b""
    text_at = bounds - low
    ink = np.frombuffer(raw, np.uint8) != 32
    starts = ink.copy()
    starts[1:] &= ~ink[:-1]
    fresh = text_at[:-1][text_at[:-1] < len(raw)]
    starts[fresh] = ink[fresh]
    at = np.flatnonzero(starts)
    if not len(at):
        return [np.empty(0, np.uint64)] * len(texts)
    # a cell is a word with the blanks after it
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)])
    coded = cells.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w.rstrip(b" ")) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.uint64)
    h = _mixed(hashes)[coded.indices.to_numpy()]
    full = _windows(h, n) if len(h) >= n else np.empty(0, np.uint64)
    out = []
    word_at = np.searchsorted(at, text_at).tolist()
    for a, b in zip(word_at, word_at[1:]):
        found = np.sort(full[a : b - n + 1] if b - a >= n else _windows(h[a:b], b - a) if b > a else full[:0])
        again = found[1:] == found[:-1]
        out.append(found[np.r_[True, ~again]] if again.any() else found)
    return out


def needed(n_a: int, n_b: int, percent: int = PERCENT) -> int:
    """Grams that sets of these sizes must share: the smallest o with 100 o >= percent (n_a + n_b - o)."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def t_occurrence(lists: list[list[int]], least: int, n_long: int) -> dict[int, int]:
    """Ids that occur in at least ``least`` of the sorted lists, and how often, by DivideSkip.

    The ``n_long`` longest lists are put aside. The others are merged with a heap; an id seen in at least
    ``least - n_long`` of them is looked up in the long lists by binary search.
    """
    by_size = sorted(lists, key=len)
    n_long = max(0, min(n_long, least - 1, len(by_size)))
    short, long_ = by_size[: len(by_size) - n_long], by_size[len(by_size) - n_long :]
    heap = [(ids[0], k, 0) for k, ids in enumerate(short) if ids]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while heap:
        top, seen = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, k, at = heap[0]
            seen += 1
            if at + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if seen < least - n_long:
            continue
        for rest, ids in enumerate(long_):
            if seen + len(long_) - rest < least:
                break
            at = bisect_left(ids, top)
            seen += at < len(ids) and ids[at] == top
        if seen >= least:
            found[top] = seen
    return found


def linked(query: np.ndarray, block: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Places in the block of the sets that link with the query."""
    sizes = [len(s) for s in block]
    able = [i for i, n in enumerate(sizes) if n and 100 * min(n, len(query)) >= percent * max(n, len(query))]
    if not able:
        return []
    held = np.concatenate([block[i] for i in able])
    owner = np.repeat(able, [sizes[i] for i in able])
    place = np.minimum(np.searchsorted(query, held), len(query) - 1)
    shared = query[place] == held
    order = np.argsort(place[shared], kind="stable")  # owners ascend in every list
    place, ids = place[shared][order], owner[shared][order].tolist()
    edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(ids)]
    lists = [ids[a:b] for a, b in zip(edges, edges[1:]) if b > a]
    least = min(needed(len(query), sizes[i], percent) for i in able)
    longest = max(map(len, lists), default=1)
    # the rule of DivideSkip for the number of long lists, with its constant
    n_long = int(least / (0.01 * np.log2(max(longest, 2)) + 1))
    found = t_occurrence(lists, least, n_long)
    return [i for i, n in found.items() if n >= needed(len(query), sizes[i], percent)]


def ids_differ(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether every row has an id of its own."""
    counts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id")).groupBy("id").count()
    return counts.where("count > 1 OR id IS NULL").isEmpty()


def row_key(differ: bool, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number that tells the rows apart: the id if the ids differ, else a 64-bit hash of id and text."""
    id_, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    return id_ if differ else F.xxhash64(id_, body)


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Key (first column) and grams of the text (last column) of every row; only a few texts are turned into grams at a time."""
    for a in range(0, batch.num_rows, HELD_TEXTS):
        part = batch.slice(a, HELD_TEXTS)
        yield from zip(part.column(0).to_pylist(), gram_sets(part.column(part.num_columns - 1)), strict=True)


def _first_pass(texts: DataFrame) -> DataFrame:
    """A row per document (id, n, hi, lo: a 128-bit hash of its set), and rows with packed bucket counts (chunk, counts)."""
    schema = "id long, n long, hi long, lo long, chunk int, counts binary"
    chunks = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        total = np.zeros(BUCKETS, np.int64)
        held: list[np.ndarray] = []
        n_held = 0

        def count() -> None:
            nonlocal n_held
            if held:
                total.__iadd__(np.bincount((np.concatenate(held) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS))
                held.clear()
                n_held = 0

        for batch in batches:
            out: dict[str, list] = {"id": batch.column(0).to_pylist(), "n": [], "hi": [], "lo": []}
            for _, g in _sets_of(batch):
                print_ = np.frombuffer(xxhash.xxh3_128_digest(g.tobytes()), dtype="<i8")
                out["n"].append(len(g))
                out["hi"].append(int(print_[0]))
                out["lo"].append(int(print_[1]))
                held.append(g)
                n_held += len(g)
                if n_held > HELD_GRAMS:
                    count()
            rows = [pa.array(v, pa.int64()) for v in out.values()]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], ["id", "n", "hi", "lo", "chunk", "counts"])
        count()
        if total.any():
            packed = [part.astype("<i8").tobytes() for part in np.split(total, chunks)]
            nulls = [pa.nulls(chunks, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(chunks), pa.int32()), pa.array(packed, pa.binary())], ["id", "n", "hi", "lo", "chunk", "counts"])

    return texts.mapInArrow(run, schema)


def _rarity(first: DataFrame) -> np.ndarray:
    """The bucket counts of all documents: BUCKETS numbers, added up by chunk in the cluster."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(packed, "<i8")
                sums[chunk] = sums[chunk] + more if chunk in sums else more
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    rows = first.where("chunk IS NOT NULL").select("chunk", "counts")
    # twice: first what few tasks hold, then the rest; at the end one row of fixed size per chunk
    summed = rows.repartition(F.col("chunk"), F.spark_partition_id() % 8).mapInArrow(add, "chunk int, counts binary")
    final = summed.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(BUCKETS, np.int64)
    size = BUCKETS // 64
    for r in final:
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.counts, "<i8")
    return out


def classes(first: DataFrame) -> DataFrame:
    """(id, n, rep): rep is the smallest id with the same set; documents without grams are left out."""
    docs = first.where("chunk IS NULL AND n > 0").select("id", "n", "hi", "lo")
    reps = docs.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    return docs.join(reps, ["hi", "lo"]).select("id", "n", "rep")


def few_rows(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast if it was counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _short_lists(texts: DataFrame, rarity: np.ndarray, percent: int, partitions: int) -> DataFrame:
    """(gram, id, n, rank): the inverted lists of the rare grams, without lists of one document; rank is the gram's
    place in the document's own order from rare to frequent."""
    spark = texts.sparkSession
    table = spark.sparkContext.broadcast(rarity)
    mean = float(rarity.mean())
    often = mean + 8 * mean**0.5 + 64  # a bucket beyond that holds a frequent gram: its lists are long and not gathered
    pack = np.dtype([("gram", "<u8"), ("id", "<i8"), ("n", "<i4"), ("rank", "<i4")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        held: list[tuple[np.ndarray, int, int]] = []
        n_held, task = 0, 0

        def blobs() -> pa.RecordBatch:
            nonlocal n_held
            rows = np.empty(n_held, pack)
            at = 0
            for g, i, n in held:
                part = rows[at : at + len(g)]
                part["gram"], part["id"], part["n"], part["rank"] = g, i, n, np.arange(len(g))
                at += len(g)
            held.clear()
            n_held = 0
            frequent = counts[(rows["gram"] % np.uint64(BUCKETS)).astype(np.int64)] > often
            to = np.where(frequent, (_mixed(rows["id"].astype(np.uint64)) % np.uint64(partitions)).astype(np.int64), ((rows["gram"] >> np.uint64(24)) % np.uint64(partitions)).astype(np.int64))
            key = 2 * to + frequent
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            stops = np.r_[starts[1:], len(key)]
            return pa.RecordBatch.from_pydict({
                "p": pa.array(key[starts] // 2, pa.int32()), "frequent": pa.array(key[starts] % 2 == 1),
                "grams": pa.array([rows["gram"][a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
                "ids": pa.array([rows["id"][a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
                "ns": pa.array([rows["n"][a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
                "ranks": pa.array([rows["rank"][a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
            })

        for batch in batches:
            for i, g in _sets_of(batch):
                n = len(g)
                if not n:
                    continue
                order = np.argsort(counts[(g % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")  # ties by hash
                rare = g[order[: n - -(-percent * n // 100) + 1]]
                held.append((rare, i, n))
                n_held += len(rare)
                if n_held > HELD_GRAMS:
                    yield blobs()
        if n_held:
            yield blobs()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def rows(g: np.ndarray, i: np.ndarray, n: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(g), 100_000):
                b = a + 100_000
                yield pa.RecordBatch.from_pydict({"gram": pa.array(g[a:b].view("<i8")), "id": pa.array(i[a:b]), "n": pa.array(n[a:b]), "rank": pa.array(k[a:b])})

        for batch in batches:
            for r in batch.to_pylist():
                g, i, n, k = (np.frombuffer(r[c], d) for c, d in (("grams", "<u8"), ("ids", "<i8"), ("ns", "<i4"), ("ranks", "<i4")))
                if r["frequent"]:
                    yield from rows(g, i, n, k)
                else:
                    kept.append((g, i, n, k))
        if kept:
            g, i, n, k = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = np.argsort(g)
            g, i, n, k = g[order], i[order], n[order], k[order]
            same = g[1:] == g[:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            yield from rows(g[shared], i[shared], n[shared], k[shared])

    packed = texts.mapInArrow(cut, "p int, frequent boolean, grams binary, ids binary, ns binary, ranks binary")
    return packed.repartition(partitions, "p").mapInArrow(lists, "gram long, id long, n int, rank int")


def _sharing(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share as many short lists as linked sets do at least.

    A set of n grams is in the lists of its n - ceil(t n) + 1 rarest ones, so ceil(t n) - 1 others come after them. Of two
    sets take the one whose rarest grams end first: of the T grams shared, all but ceil(t n) - 1 at most are among those
    and thereby among the other's rarest as well. The sets share T - ceil(t n) + 1 lists then, n being the larger size at least.
    """
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    rare = held(lists.join(few_rows(ids), "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.collect_list("gram").alias("rare")))
    sides = [rare.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("rare").alias(f"rare_{c}")) for c in "ab"]
    largest = F.greatest("n_a", "n_b")
    least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent)) - F.ceil(largest * percent / 100) + 1
    enough = F.size(F.array_intersect("rare_a", "rare_b")) >= least
    out = stored_ids(few_rows(pairs).join(sides[0], "a").join(sides[1], "b").where(enough).select("a", "b"), "sharing")
    forget(rare)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The links among candidate pairs (a, b): b's are queries, their a's are searched in blocks of bounded size."""
    met = stored_ids(pairs.select("a", "b"), "candidates")
    pairs = _sharing(met, lists, percent)
    forget(met)
    blocks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    salted = stored_ids(pairs.join(blocks, "b").select("a", "b", F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("block")), "blocks")
    queries = blocks.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = salted.unionAll(queries.select("a", "b", F.col("block").cast("int")))
    wanted = stored_ids(wanted, "wanted")
    rows = texts.join(few_rows(wanted.withColumnRenamed("a", "id")), "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, ids, sets = None, None, [], []

        def found() -> pa.RecordBatch:
            hits = linked(query, sets, percent) if query is not None else []
            return pa.RecordBatch.from_pydict({"a": pa.array([ids[h] for h in hits], pa.int64()), "b": pa.array([key[0]] * len(hits), pa.int64())})

        for batch in batches:
            of_rows = zip(batch.column("b").to_pylist(), batch.column("block").to_pylist(), _sets_of(batch), strict=True)
            for b, block, (i, g) in of_rows:
                if (b, block) != key:
                    if key is not None:
                        yield found()
                    key, query, ids, sets = (b, block), None, [], []
                if i == b:
                    query = g
                else:
                    ids.append(i)
                    sets.append(g)
                    if len(sets) >= 2 * BLOCK and query is not None:
                        yield found()
                        ids, sets = [], []
        if key is not None:
            yield found()

    first = (F.col("id") != F.col("b")).cast("int")
    grouped = rows.select("id", "b", "block", "text", first.alias("later")).repartition("b", "block").sortWithinPartitions("b", "block", "later")
    links = stored_ids(grouped.select("id", "b", "block", "text").mapInArrow(search, "a long, b long"), "found")
    forget(pairs, salted, wanted)
    return links


def _heads(lists: DataFrame, order: Column) -> DataFrame:
    """(gram, head): the document of each list that ranks highest, the smallest id of equals."""
    best = F.max_by(F.struct("id", "n", "component", "rank"), F.struct(order, -F.col("id")))
    return lists.groupBy("gram").agg(best.alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").select("gram", "head")


def _open(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The lists whose documents are in different components, with the documents' components."""
    placed = lists.drop("component").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    return held(placed.join(mixed, "gram"))


def _candidates(lists: DataFrame, heads: DataFrame, percent: int, both: bool = False) -> DataFrame:
    """(a, b): documents of different components that meet in a list and can still reach the required overlap.

    Of the T grams that two linked sets share at least, the rarest has T - 1 others after it in both sets, so it
    stands at a rank of at most n - T in either. Every linked pair therefore meets in a list in which both ranks
    allow it. A near copy whose own changes fill its first ranks meets nobody there.
    """
    shared = F.ceil((F.col("n") + F.col("head.n")) * percent / (100 + percent))
    met = lists.join(heads, "gram").where("component <> head.component").where("component > head.component" if both else "id <> head.id")
    able = (F.col("rank") <= F.col("n") - shared) & (F.col("head.rank") <= F.col("head.n") - shared)
    return met.where(able).select(F.col("id").alias("a"), F.col("head.id").alias("b")).distinct()


def keyed_components(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, n, component) of (id, text) rows with different ids; component is the smallest id reachable by links."""
    spark = texts.sparkSession
    first = stored(_first_pass(texts), "sets")
    members = stored_ids(classes(first), "classes")
    others = few_rows(members.where("id <> rep").select("id"))
    alone = texts.join(others, "id", "left_anti")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    short = held(_short_lists(alone, _rarity(first), percent, partitions))
    # heads: of every list the document whose lists are longest in all, which is the most central of near copies
    lengths = short.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    weights = short.join(lengths, "gram").groupBy("id").agg(F.sum("m").alias("weight"))
    weighed = held(short.join(weights, "id").withColumn("component", F.col("id")))
    forget(short)
    found = _verified(_candidates(weighed, _heads(weighed, F.col("weight")), percent), texts, weighed, percent)
    parts = components(found)
    open_ = _open(weighed, parts)
    for turn in range(1, EXTRA_HEADS + 1):
        more = _verified(_candidates(open_, _heads(open_, F.xxhash64("id", F.lit(turn))), percent), texts, weighed, percent)
        if more.isEmpty():
            break
        found = found.unionAll(more)
        parts = components(found)
        closing, open_ = open_, _open(open_, parts)  # components only grow, so a closed list stays closed
        forget(closing)
    across = _candidates(open_, open_.select("gram", F.struct("id", "n", "component", "rank").alias("head")), percent, both=True)
    more = _verified(across, texts, weighed, percent)
    whole = components(found.unionAll(more)) if not more.isEmpty() else parts
    forget(weighed, open_)
    by_rep = whole.select(F.col("id").alias("rep"), "component")
    placed_docs = members.join(by_rep, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    sized = first.where("chunk IS NULL").select("id", "n")
    return sized.join(placed_docs, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def row_components(docs: DataFrame, differ: bool, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, id, n, component) of the different rows; component is one of their keys (``row_key``), the smallest."""
    key, id_, body = row_key(differ, doc_id, text), F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    if differ:
        found = keyed_components(docs.select(key.alias("id"), body.alias("text")), percent)
        return found.select(F.col("id").alias("key"), "id", "n", "component")
    rows = stored(docs.select(key.alias("key"), id_.alias("id"), body.alias("text")).dropDuplicates(["key"]), "rows")
    found = keyed_components(rows.select(F.col("key").alias("id"), "text"), percent).withColumnRenamed("id", "key")
    return rows.select("key", "id").join(found, "key").select("key", "id", "n", "component")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    differ = ids_differ(docs, doc_id)
    found = row_components(docs, differ, doc_id, text, percent)
    if differ:
        return found.select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    least = found.groupBy("component").agg(F.min("id").alias("component_id"))
    by_key = found.join(few_rows(least), "component").select("key", F.col("n").alias("n_shingles"), "component_id")
    rows = docs.select(row_key(differ, doc_id, text).alias("key"), F.col(f"`{doc_id}`").cast("long").alias("id"))
    return rows.join(by_key, "key").select("id", "n_shingles", "component_id")
