"""Periodic runs of words, found online by catchers over dyadic blocks.

A run is a stretch of consecutive words with smallest period q and at least max(12, 2 q) words that no neighbouring
word extends with the same period. It holds a square, two equal halves of q words, and a half of at least 2 L - 1 words
holds a whole block of L words that starts at a multiple of L. So for every power of two L, a completed block [l, l + L)
has a catcher that waits for the block to come again at a distance of 2 L - 1 to 4 L - 2 words: over all L these are all
periods from 1 on. A word that is appended at the end of a window of L words meets just two such catchers per level,
and the comparison is one of window hashes. A catch at distance p is advanced to both sides: neighbouring catches of one
distance are one stretch, whose ends lie less than L words beyond its outer blocks and are found by halving steps on
prefix hashes. A stretch [a, e) in which word x equals word x + p is a square if e - a >= p, and then the run [a, e + p);
squares of a multiple of the period span the same words and merge into the run with the smallest period.

The words appended to one document meet only catchers of completed blocks before them; a whole chunk of appended words,
of many documents at once, is advanced by one NumPy step per level, so a chunk of n words costs n log n. Words are numbered
exactly and every reported run is compared word by word, so a hash collision can't give a wrong run; equal windows
have equal hashes, so none is missed.

Defined results: a null or blank text has no words and no runs; one text may have any length (memory is linear in it);
repeated rows give repeated results; an empty table gives an empty result; the columns of the input are kept in ``row``
beside the results, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words.
LEAST = 12
#: Words that are advanced together; a longer document is a chunk of its own.
CHUNK = 250_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


class Catchers:
    """Catchers over one sequence of numbers: ``runs`` gives its runs as rows (start, length, period)."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        n = len(ids)
        self.power, self.inverse = _powers(BASE, n + 1), _powers(INVERSE, n + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(ids) * self.power[:n])])

    def equal(self, at: np.ndarray, period: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words from ``at`` come again ``period`` words later; places beyond the ends are unequal."""
        inside = (at >= 0) & (at + period + size < len(self.prefix))
        x = np.where(inside, at, 0)
        y = np.where(inside, at + period, 0)
        size_x, size_y = np.where(inside, x + size, 0), np.where(inside, y + size, 0)
        first = (self.prefix[size_x] - self.prefix[x]) * self.power[np.where(inside, period, 0)]
        return inside & (first == self.prefix[size_y] - self.prefix[y])

    def caught(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(block start, distance) of every block of ``size`` words that came again at a distance of this level."""
        windows = (self.prefix[size:] - self.prefix[:-size]) * self.inverse[: len(self.ids) - size + 1]
        blocks = windows[::size]
        starts, periods = [], []
        for least in (2 * size - 1, 3 * size - 1):  # an appended word meets the catcher at least that far back, and the one before
            ends = windows[least:]
            waiting = np.repeat(blocks[: -(-len(ends) // size)], size)[: len(ends)]
            hit = np.flatnonzero(waiting == ends)
            start = hit // size * size
            starts.append(start)
            periods.append(hit + least - start)
        return np.concatenate(starts), np.concatenate(periods)

    def stretches(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, period): the maximal stretches with word x = word x + period that hold a catch of this level."""
        start, period = self.caught(size)
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + size)
        first, distance = start[new], period[new]
        end = start[np.append(new[1:], True)[: len(start)]] + size
        step = size // 2
        while step:
            first = first - step * self.equal(first - step, distance, step)
            end = end + step * self.equal(end, distance, step)
            step //= 2
        return first, end, distance

    def exact(self, first: int, end: int, period: int) -> tuple[int, int]:
        """The stretch by comparison of the words themselves, around its middle."""
        same = np.flatnonzero(self.ids[:-period] != self.ids[period:])
        middle = (first + end) // 2
        at = np.searchsorted(same, middle)
        return int(same[at - 1] + 1) if at else 0, int(same[at]) if at < len(same) else len(self.ids) - period

    def runs(self, longest: int, least: int = LEAST) -> np.ndarray:
        """Runs by start, then period. ``longest``: words of the longest text in the sequence."""
        found, size = [np.empty((0, 3), np.int64)], 1
        while 2 * (2 * size - 1) <= longest:
            first, end, period = self.stretches(size)
            square = (end - first >= period) & (end - first + period >= least)
            found.append(np.column_stack([first, end, period])[square])
            size *= 2
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1] + rows[:, 2], rows[:, 0]))]
        spans = rows[:, 1] + rows[:, 2]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (spans[1:] != spans[:-1])  # the smallest period of a span comes first
        out = []
        for first, end, period in rows[new].tolist():
            if not np.array_equal(self.ids[first:end], self.ids[first + period : end + period]):
                first, end = self.exact(first, end, period)
                if end - first < period or end - first + period < least:
                    continue
            out.append((first, end - first + period, period))
        return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one list of words."""
    known: dict = {}
    ids = np.fromiter(map(known.setdefault, words, count()), np.int64, len(words))
    return [tuple(r) for r in Catchers(ids).runs(len(words)).tolist()]


def _chunk_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of several texts; between them stand numbers that are equal to nothing."""
    known: dict[bytes, int] = {}
    number = count()
    sizes = [len(t) + 1 for t in texts]
    ends = np.cumsum(sizes)
    ids = np.empty(ends[-1], np.int64)
    for k, (words, end) in enumerate(zip(texts, ends.tolist(), strict=True)):
        ids[end - len(words) - 1 : end - 1] = np.fromiter(map(known.setdefault, words, number), np.int64, len(words))
        ids[end - 1] = -1 - k
    rows = Catchers(ids).runs(max(sizes) - 1)
    owner = np.searchsorted(ends, rows[:, 0], side="right")
    rows[:, 0] -= (ends - sizes)[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, every run cut to its first period."""
    if not len(runs):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns but the text), n_words, runs (by start, then period) and collapsed."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others, F.lit(0).alias("__")).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

        def done(part: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            found = _chunk_runs(texts)
            flat = np.concatenate(found)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]),
            )
            kept = [collapse(w, r) for w, r in zip(texts, found, strict=True)]
            return pa.RecordBatch.from_arrays(
                [part, pa.array([len(t) for t in texts], pa.int64()), lists.cast(kind), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_words", "runs", "collapsed"],
            )

        for batch in batches:
            held: list[list[bytes]] = []
            n, start = 0, 0
            for at, value in enumerate(batch.column(1)):
                held.append((value.as_py() or "").encode().split())  # of bytes: ASCII white space only
                n += len(held[-1])
                if n >= CHUNK:
                    yield done(batch.column(0).slice(start, len(held)), held)
                    held, n, start = [], 0, at + 1
            if held:
                yield done(batch.column(0).slice(start, len(held)), held)

    row = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {row}, n_words bigint, runs {RUNS}, collapsed string")
    fields = [c for c in docs.columns if c != text]
    return out.withColumn("row", F.struct(*[F.col("row").getField(c).alias(c) for c in fields])) if fields else out
