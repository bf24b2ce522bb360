"""Near duplicates of embedding vectors: sign hashing in several tables, exact cosine, connected components.

1. Every vector gets a sketch: one bit per random hyperplane, the side it lies on. The hyperplanes are the same in all
   tasks. Equal vectors of one label are one node from here on, with a count of its rows.
2. Table t takes ``bits`` bits of the sketch as its key. Two vectors at angle a agree in a bit with probability 1 - a/pi;
   the number of bits follows the number of rows, so that a bucket of unrelated vectors keeps about ``BUCKET`` rows, and
   the number of tables follows from the bits, so that a pair at the threshold itself is missed by all tables with
   probability at most ``MISS``; nearer pairs are missed far less.
3. Buckets carry sketches, not vectors. A task compares all sketches of a block and passes on the nodes that have
   a partner within the Hamming distance that near pairs keep (ten standard deviations). Only those get their vectors.
4. The blocks of those vectors are compared by exact cosine in double precision. A pair counts in the first table in which
   its keys agree, so that no pair counts twice. A block gives sums of links per node and at most one edge per
   node to the smallest node of its local component: pairs are never emitted.
5. Components of these edges are built by joins.

A bucket of more than ``BLOCK`` nodes is dealt into chunks by a hash, and every two chunks meet in a block of
their own; so a hot bucket is many bounded tasks and nothing is dropped. Its comparisons still grow with the square
of the number of different vectors in it, as links are counted exactly.

Defined results: a vector that is null, zero, empty, or has a null or non-finite component, and one without label, has no
links and is its own component; vectors of different length are never near; rows of one id are different vectors;
a row without id takes the smallest id of its component, null if there is none; equal rows link with each other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.jaccard import few_rows
from tallyweir.llm.links import components, stored

THRESHOLD = 0.98
#: Unrelated vectors of a bucket, on average over all labels.
BUCKET = 2048
#: Most nodes that one side of a block holds.
BLOCK = 4096
#: Chance that no table holds a pair at the threshold.
MISS = 1e-4
#: Least bits of a sketch.
SKETCH = 128
SEED = 20240607
#: Rows of a block that are compared with all others at once.
STRIP = 256


def bits_of(rows: int) -> int:
    """Bits of a key: buckets of unrelated vectors keep their size as the table grows."""
    return max(4, ceil(log2(max(rows, 1) / BUCKET))) if rows > BUCKET else 4


def tables_of(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables until a pair at the threshold is missed with at most the given probability."""
    together = (1 - acos(min(threshold, 1.0)) / pi) ** bits
    return 1 if together >= 1 else max(1, ceil(log(miss) / log(1 - together)))


def _width(bits: int, tables: int) -> int:
    return max(SKETCH, -(-bits * tables // 64) * 64)


@lru_cache(maxsize=8)
def _planes(size: int, width: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(SEED)).standard_normal((size, width))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    scaled = vectors.astype(np.float64)
    scaled = scaled / np.abs(scaled).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _keys(sketches: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of every sketch (a row of packed bytes) in every table."""
    flags = np.unpackbits(sketches, axis=1, count=bits * tables).reshape(len(sketches), tables, bits)
    return flags @ (1 << np.arange(bits, dtype=np.int64))


def _sketched(vectors: DataFrame, width: int) -> DataFrame:
    """(id, node, label, size, sketch, vector); node is a 128-bit hash of label and vector, null where nothing can be near."""
    float_type = vectors.schema["vector"].dataType.elementType.simpleString()
    dtype = np.float32 if float_type == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, labels, lists = batch.columns
            known = labels.to_pylist()
            nodes: list[bytes | None] = [None] * batch.num_rows
            sketches: list[bytes | None] = [None] * batch.num_rows
            offsets, flat = np.asarray(lists.offsets), lists.values
            filled = np.asarray(flat.is_valid())
            numbers = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype, copy=False) + dtype(0)  # -0 is 0
            fine = np.concatenate([[0], np.cumsum(filled & np.isfinite(numbers))])
            sizes = np.where(np.asarray(lists.is_valid()), np.diff(offsets), 0)
            able = (sizes > 0) & (fine[offsets[1:]] - fine[offsets[:-1]] == sizes) & np.array([x is not None for x in known], bool)
            for size in np.unique(sizes[able]).tolist():
                at = np.flatnonzero(able & (sizes == size))
                block = numbers[offsets[at][:, None] + np.arange(size)]
                nonzero = (block != 0).any(axis=1)
                at, block = at[nonzero], np.ascontiguousarray(block[nonzero])
                if not len(at):
                    continue
                packed = np.packbits(_units(block) @ _planes(size, width) >= 0, axis=1)
                for k, i in enumerate(at.tolist()):
                    nodes[i] = xxhash.xxh3_128_digest(known[i].encode() + b"\0" + block[k].tobytes())
                    sketches[i] = packed[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nodes, pa.binary()), labels, pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists],
                ["id", "node", "label", "size", "sketch", "vector"],
            )

    return vectors.mapInArrow(run, f"id long, node binary, label string, size int, sketch binary, vector array<{float_type}>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, which the partition is sorted by."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:keys]:
            codes = np.asarray(column.dictionary_encode().indices)
            new[1:] |= codes[1:] != codes[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(c[a].as_py() for c in batch.columns[:keys])
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _packed(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long binaries as rows of bytes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


PLACE = ["t", "label", "size", "key", "low", "high"]
PLACE_SCHEMA = "t int, label string, size int, key long, low int, high int"


def _blocks(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(place columns, part, node, sketch): every two nodes of a bucket are in one block of it, or in one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_packed(pa.chunked_array([batch.column("sketch")])), bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    keyed = nodes.mapInArrow(run, "node binary, label string, size int, sketch binary, keys array<long>")
    rows = keyed.select("node", "label", "size", "sketch", F.posexplode("keys").alias("t", "key"))
    bucket = ["t", "label", "size", "key"]
    # few buckets are beyond a block: the number of such is at most that of all places divided by BLOCK
    large = stored(rows.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")).where("chunks > 1"), "buckets")
    part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = rows.join(few_rows(large), bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("part", part)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.select(*bucket, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "sketch")


def _pairs(
    table: pa.Table, keys: np.ndarray, near: Callable[[slice], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered pairs (rows, rows) of a block that are near, belong to this block and agree in no earlier table."""
    t, low, high = (table.column(c)[0].as_py() for c in ("t", "low", "high"))
    part = table.column("part").to_numpy()
    for a in range(0, table.num_rows, STRIP):
        strip = slice(a, a + STRIP)
        close = near(strip)
        if low != high:  # pairs inside a chunk belong to the chunk's own block
            close &= part[strip, None] != part[None, :]
        i, j = np.nonzero(close)
        i = i + a
        first = i != j
        for earlier in range(t):
            first &= keys[i, earlier] != keys[j, earlier]
        yield i[first], j[first]


def _candidates(blocks: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """The places and nodes that have a partner within the Hamming distance of near pairs."""
    share = acos(min(threshold, 1.0)) / pi
    width = _width(bits, tables)
    most = int(width * share + 10 * sqrt(width * share * (1 - share)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, len(PLACE)):
            if table.num_rows < 2:
                continue
            packed = _packed(table.column("sketch"))
            words, keys = packed.view(np.uint64), _keys(packed, bits, tables)

            def near(strip: slice) -> np.ndarray:
                far = np.zeros((len(words[strip]), len(words)), np.uint16)
                for k in range(words.shape[1]):
                    far += np.bitwise_count(words[strip, k, None] ^ words[None, :, k])
                return far <= most

            alive = np.zeros(table.num_rows, bool)
            for i, j in _pairs(table, keys, near):
                alive[i] = alive[j] = True
            if alive.any():
                yield from table.filter(pa.array(alive)).combine_chunks().to_batches()

    dealt = blocks.repartition(*PLACE).sortWithinPartitions(*PLACE)
    return dealt.mapInArrow(run, f"{PLACE_SCHEMA}, part int, node binary, sketch binary")


def _local_roots(adjacent: np.ndarray) -> np.ndarray:
    """The smallest row of every row's component; each row's neighbours are read once."""
    n = len(adjacent)
    root = np.full(n, -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        border = np.array([start])
        while len(border):
            reached = np.unpackbits(np.bitwise_or.reduce(adjacent[border], axis=0), count=n).astype(bool) & (root < 0)
            border = np.flatnonzero(reached)
            root[border] = start
    return root


def _linked(candidates: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(node, links, other): rows that a node links with in a block, and the smallest node of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, len(PLACE)):
            if table.num_rows < 2:
                continue
            keys = _keys(_packed(table.column("sketch")), bits, tables)
            vectors = table.column("vector").combine_chunks()
            units = _units(vectors.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1))
            rows = table.column("m").to_numpy()
            links = np.zeros(table.num_rows, np.int64)
            adjacent = np.zeros((table.num_rows, -(-table.num_rows // 8)), np.uint8)
            for i, j in _pairs(table, keys, lambda strip, units=units: units[strip] @ units.T >= threshold):
                np.add.at(links, i, rows[j])
                np.bitwise_or.at(adjacent, (i, j // 8), (128 >> (j % 8)).astype(np.uint8))
            hit = np.flatnonzero(links)
            if len(hit):
                nodes = table.column("node").to_pylist()
                roots = _local_roots(adjacent)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([nodes[i] for i in hit.tolist()], pa.binary()), "links": pa.array(links[hit]),
                    "other": pa.array([nodes[r] for r in roots[hit].tolist()], pa.binary()),
                })

    return candidates.mapInArrow(run, "node binary, links long, other binary")


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """Per row: id, n_links (other rows of its label with a cosine of at least ``threshold``), component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a positive cosine")
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("vector")
    )
    bits = bits_of(rows.count())
    tables = tables_of(bits, threshold)
    marked = stored(_sketched(rows, _width(bits, tables)), "sketches")
    able = marked.where("node IS NOT NULL")
    nodes = stored(
        able.groupBy("node").agg(
            F.count(F.lit(1)).alias("m"), F.min("id").alias("least"), *[F.any_value(c).alias(c) for c in ("label", "size", "sketch")]
        ),
        "nodes",
    )
    close = stored(_candidates(_blocks(nodes.select("node", "label", "size", "sketch"), bits, tables), bits, tables, threshold), "close")
    wanted = few_rows(stored(close.select("node").distinct(), "wanted"))
    shown = able.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("vector").alias("vector"))
    counted = nodes.join(wanted, "node", "left_semi").select("node", "m")
    placed = close.join(shown, "node").join(counted, "node").select(*PLACE, "part", "node", "sketch", "m", "vector")
    dealt = placed.repartition(*PLACE).sortWithinPartitions(*PLACE)
    found = stored(_linked(dealt, bits, tables, threshold), "links")
    whole = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed_nodes = nodes.join(whole.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = placed_nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    results = (
        placed_nodes.join(firsts, "component").join(sums, "node", "left")
        .select("node", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id").where("n_links > 0")
    )
    out = marked.select("id", "node").join(few_rows(stored(results, "results")), "node", "left")
    least = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), least.alias("component_id"), F.col("id").eqNullSafe(least).alias("kept"))
