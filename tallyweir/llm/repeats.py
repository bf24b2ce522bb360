"""Removal of byte strings that occur more than once, by prefix-free parsing.

A byte is removed if it lies in a string of LENGTH bytes that also starts anywhere else in the corpus. The
question for every start is whether its suffix has a neighbour in corpus order with LENGTH bytes in common.
Prefix-free parsing answers it for whole phrases at once:

* Trigger: the smallest rolling hash among the REACH grams that follow a start. It depends on these bytes
  alone, so equal strings have the same trigger at the same place; successive starts with one trigger form a
  phrase of at most REACH starts. All this happens inside one document.
* Dictionary and parse: a phrase stands for its context, the bytes from its first start to the end of its
  last string. Contexts are counted over the corpus; a context seen twice repeats all its strings.
* Corpus order: a string that starts in another phrase can only be equal if the bytes after the trigger
  (LENGTH - REACH + 1 of them, in every string of the phrase) are equal. These order the phrases into groups.
  Groups with one phrase end here, groups with one context are settled; only for the contexts of the other
  groups are the single strings compared, each context once however often it occurs.

Since only equality to depth LENGTH matters, the ranks of suffixes are replaced by 64-bit hashes that are
compared inside a group with an equal 64-bit hash (128 bits in all); a global sort is not needed. Every
task first settles what repeats inside what it holds and passes one row of it on, so a passage in a third
of all documents reaches the grouping task as one row per task.

Defined results: a null text is an empty one; texts under LENGTH bytes have no string; repeated rows repeat
each other; rows are told apart by their id, or by a hash of id and text where ids repeat or are null, so that
different texts of one id are different documents; strings overlap freely and are judged on the input; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.jaccard import ids_differ, row_key
from tallyweir.llm.links import stored

LENGTH = 400
REACH = 160
GRAM = 16
SEGMENT = 1 << 18
HELD_ROWS, SLICE_ROWS = 250_000, 256
#: Parts of a shuffle of packed rows for each of the session's shuffle partitions.
PARTS = 3
#: Rows up to which a table of contexts by document is broadcast, and their MB; beyond, texts are shuffled.
BROADCAST_ROWS, BROADCAST_MB = 300_000, 64

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.array([hash_ * 0xD6E8FEB86659FD93 % (1 << 64) for hash_ in ((k + 1) ** 5 * 0x2545F4914F6CDD1D % (1 << 64) for k in range(256))], np.uint64)
_BYTE ^= _BYTE >> np.uint64(29)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any range of a byte string, from sums of weighted bytes; equal bytes have equal hashes anywhere."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """For every full window, the place of its smallest value, the first of equal ones; by doubling widths."""
    at, best, size = np.arange(len(values)), values, 1
    while 2 * size <= width:
        later = best[size:] < best[:-size]
        best, at = np.where(later, best[size:], best[:-size]), np.where(later, at[size:], at[:-size])
        size *= 2
    if rest := width - size:
        later = best[rest:] < best[: len(best) - rest]
        at = np.where(later, at[rest:], at[: len(at) - rest])
    return at


def phrases(raw: np.ndarray, length: int = LENGTH, reach: int = REACH) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, context, first, last) of the phrases of a text, segment by segment; first and last are string starts."""
    starts = len(raw) - length + 1
    for begin in range(0, max(0, starts), SEGMENT):
        n = min(SEGMENT, starts - begin)
        roll = Rolling(raw[begin : begin + n + length - 1])
        at = np.arange(n + reach - 1)
        trigger = least_in_window(roll.of(at, at + GRAM), reach)
        cut = np.flatnonzero(trigger[1:] != trigger[:-1]) + 1
        first = np.r_[0, cut]
        last = np.r_[cut, n] - 1
        t = trigger[first]
        shape = _mixed(((t - first) * 4096 + (last - first)).astype(np.uint64))
        with np.errstate(over="ignore"):
            yield roll.of(t, t + length - reach + 1), roll.of(first, last + length) + shape, first + begin, last + begin


# One row of a phrase or a string: its group, the hash that must be equal, document, first and last start, and
# whether it stands for others (then it is not to be reported, or known to be repeated).
ROW = np.dtype([("group", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("last", "<i4"), ("known", "?")])
BLOB = "p int, settled boolean, " + ", ".join(f"{c} binary" for c in ROW.names)


def _blob(rows: np.ndarray, to: np.ndarray, settled: bool) -> pa.RecordBatch:
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
    cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=False))
    columns = {c: pa.array([np.ascontiguousarray(rows[c][a:b]).tobytes() for a, b in cuts], pa.binary()) for c in ROW.names}
    return pa.RecordBatch.from_pydict({"p": pa.array(to[starts], pa.int32()), "settled": pa.array([settled] * len(cuts), pa.bool_()), **columns})


def _unblob(r: dict) -> np.ndarray:
    arrays = {c: np.frombuffer(r[c], ROW[c]) for c in ROW.names}
    rows = np.empty(len(arrays["doc"]), ROW)
    for c, a in arrays.items():
        rows[c] = a
    return rows


def _runs(rows: np.ndarray, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by columns, the number of the run of equal rows each is in, and the sizes of the runs."""
    rows = rows[np.lexsort([rows[c] for c in reversed(by)])]
    if not len(rows):
        return rows, np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.zeros(len(rows), bool)
    for c in by:
        change[1:] |= rows[c][1:] != rows[c][:-1]
    run = np.cumsum(change)
    return rows, run, np.bincount(run)


def _grouped(source: Iterator[np.ndarray], by: tuple[str, ...], partitions: int) -> Iterator[pa.RecordBatch]:
    """Packed rows by partition of their group. Rows that share their key with others in hand are settled: they
    go on as they are, and one row that stands for them goes to the group."""
    held: list[np.ndarray] = []
    n_held = 0

    def packed() -> Iterator[pa.RecordBatch]:
        rows, run, sizes = _runs(np.concatenate(held), by)
        many = sizes[run] > 1
        stand_in = rows[many & np.r_[True, run[1:] != run[:-1]]].copy()
        stand_in["known"], stand_in["first"] = True, -1
        settled = rows[many]
        out = np.concatenate([rows[~many], stand_in])
        yield _blob(out, ((out["group"] >> np.uint64(20)) % np.uint64(partitions)).astype(np.int64), False)
        if len(settled):
            yield _blob(settled, np.arange(len(settled)) * partitions // len(settled), True)

    for rows in source:
        held.append(rows)
        n_held += len(rows)
        if n_held > HELD_ROWS:
            yield from packed()
            held.clear()
            n_held = 0
    if n_held:
        yield from packed()


def _shared(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[np.ndarray]:
    """The rows whose key occurs more than once in the corpus."""
    held = []
    for batch in batches:
        for a in range(batch.num_rows):  # row by row: a row holds many
            r = batch.slice(a, 1).to_pylist()[0]
            if r["settled"]:
                yield _unblob(r)
            else:
                held.append(_unblob(r))
    if held:
        joined = np.concatenate(held)
        held.clear()
        rows, run, sizes = _runs(joined, by)
        del joined
        stands = np.bincount(run, rows["known"]) > 0 if len(rows) else sizes
        yield rows[((sizes[run] > 1) | stands[run]) & (rows["first"] >= 0)] if len(rows) else rows


def _by_batches(rows: np.ndarray, columns: Callable[[np.ndarray], dict]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 100_000):
        yield pa.RecordBatch.from_pydict(columns(rows[a : a + 100_000]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in small parts, so that few texts are held as Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(a, SLICE_ROWS)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = row_key(ids_differ(docs, doc_id), doc_id, text)
    return docs.select(key.alias("doc"), F.col(f"`{doc_id}`").alias("id"), body.alias("text"))


def _few_lists(lists: DataFrame) -> DataFrame:
    """Lists by document, hinted for broadcast if they were counted to be few and short."""
    few, total = lists.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.size("list"))).first()
    return F.broadcast(lists) if few <= BROADCAST_ROWS and (total or 0) * 40 <= BROADCAST_MB << 20 else lists


def repeated_ranges(texts: DataFrame, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """(doc, first, end): ranges of bytes, overlapping, that together are the bytes in repeated strings."""
    spark = texts.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    partitions = PARTS * files

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[np.ndarray]:
            for batch in _slices(batches):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for group, context, first, last in phrases(np.frombuffer(text.encode(), np.uint8), length, reach):
                        rows = np.empty(len(group), ROW)
                        rows["group"], rows["hash"], rows["doc"], rows["first"], rows["last"], rows["known"] = group, context, doc, first, last, False
                        yield rows

        yield from _grouped(source(), ("group",), partitions)

    def shared_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shared(batches, ("group",)):
            yield from _by_batches(rows, lambda r: {
                "grp": pa.array(r["group"].view("<i8").copy()), "context": pa.array(r["hash"].view("<i8").copy()), "doc": pa.array(r["doc"].copy()),
                "first": pa.array(r["first"].astype(np.int64)), "last": pa.array(r["last"].astype(np.int64)),
            })

    packed = texts.select("doc", "text").mapInArrow(parsed, BLOB)
    grouped = packed.repartition(partitions, "p").mapInArrow(shared_phrases, "grp long, context long, doc long, first long, last long")
    # a task takes PARTS parts in turn and writes one file of them: every file made costs its executor a process on a local file system
    shared = stored(grouped.coalesce(files), "phrases")
    dictionary = stored(
        shared.groupBy("grp", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "first", "last")).alias("one")), "dictionary"
    )
    whole = shared.join(dictionary.where("n > 1").select("grp", "context"), ["grp", "context"]).select("doc", "first", (F.col("last") + length).alias("end"))
    mixed = dictionary.groupBy("grp").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select("grp")
    open_ = dictionary.join(mixed, "grp").select("one.doc", F.struct("grp", "one.first", "one.last", (F.col("n") > 1).alias("known")).alias("c"))
    lists = stored(open_.groupBy("doc").agg(F.collect_list("c").alias("list")), "open")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[np.ndarray]:
            for batch in _slices(batches):
                for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "list")), strict=True):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    for c in found:
                        n = c["last"] - c["first"] + 1
                        roll = Rolling(raw[c["first"] : c["last"] + length])
                        rows = np.empty(n, ROW)
                        at = np.arange(n)
                        rows["group"], rows["hash"], rows["doc"] = np.array(c["grp"], np.int64).astype(np.uint64), roll.of(at, at + length), doc
                        rows["first"] = rows["last"] = at + c["first"]
                        rows["known"] = c["known"]
                        yield rows

        yield from _grouped(source(), ("group", "hash"), partitions)

    def shared_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shared(batches, ("group", "hash")):
            rows = np.sort(rows, order=("doc", "first"))
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["first"][1:] > rows["first"][:-1] + 1)
            start = np.flatnonzero(fresh)
            stop = np.r_[start[1:], len(rows)] - 1 if len(start) else start
            ranges = np.rec.fromarrays([rows["doc"][start], rows["first"][start].astype(np.int64), rows["first"][stop].astype(np.int64) + length], names="doc,first,end")
            yield from _by_batches(ranges, lambda r: {c: pa.array(np.ascontiguousarray(r[c])) for c in ("doc", "first", "end")})

    beside = texts.join(_few_lists(lists), "doc").select("doc", "text", "list")
    single = beside.mapInArrow(strings, BLOB).repartition(partitions, "p").mapInArrow(shared_strings, "doc long, first long, end long")
    return whole.unionAll(single)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that ranges cover; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """Per document: id, n_bytes, removed (maximal runs of bytes, end exclusive), kept (the remaining bytes)."""
    return _applied(docs, doc_id, text, length, reach, "kept binary", lambda kept: pa.array(kept, pa.binary()))


def repeat_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """As :func:`without_repeats`, with kept_sha256 in place of the bytes."""
    return _applied(docs, doc_id, text, length, reach, "kept_sha256 string", lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))


def _applied(docs: DataFrame, doc_id: str, text: str, length: int, reach: int, column: str, shown: Callable) -> DataFrame:
    if reach + GRAM - 1 > length:
        raise ValueError("a trigger must lie inside every string")
    texts = _texts(docs, doc_id, text)
    by_doc = stored(repeated_ranges(texts, length, reach).groupBy("doc").agg(F.collect_set(F.struct("first", "end")).alias("list")), "ranges")
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, removed, kept = [], [], []
            for body, found in zip(batch.column("text").to_pylist(), batch.column("list").to_pylist(), strict=True):
                raw = body.encode()
                runs = merged([(r["first"], r["end"]) for r in found or []])
                edges = [0, *[x for r in runs for x in r], len(raw)]
                sizes.append(len(raw))
                removed.append([{"first": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), shown(kept)], ["id", "n_bytes", "removed", column.split()[0]])

    # ranges grow with the corpus, so the texts meet them by a shuffle at every size
    return texts.join(by_doc.hint("merge"), "doc", "left").select("id", "text", "list").mapInArrow(run, f"id {id_type}, n_bytes long, removed array<struct<first:long,end:long>>, {column}")
