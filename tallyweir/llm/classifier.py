"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms of a text are pairs of neighbouring character classes and a few counts in bins (words, repeated word
triples, symbols, capitals). Their document frequencies come from all documents. Labelled rows up to a stated
number are reduced to latent vectors by a singular value decomposition; these vectors are broadcast, their
size being SAMPLE x DIMENSIONS whatever the corpus. Every document is then compared with every one of them,
exactly, in blocks of matrix products, and the labels of its nearest neighbours vote with their similarity.

SAMPLE bounds the labelled rows: those with the smallest hash of their text. Nothing but the text is an
input of a score, and the score of a text does not depend on the rest of its batch.

Defined results: a null text is an empty one, which has a score like any other; labels that are null or
belong to no document are ignored, as are labels of rows that are held out; a document with several labels
counts once for each; without any usable label every score is 0.5; repeated rows get equal scores; an
empty table gives an empty result; other columns are kept, except that ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SAMPLE = 6_000
DIMENSIONS = 32
NEIGHBOURS = 41
POWER = 8
BLOCK_DOCS = 512
THRESHOLD = 0.7

# Character classes by byte: each of the marks that stand out in junk is a class of its own.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?"]
_GROUPS += [bytes([c]) for c in b"#*$%&|<>@"] + [b"\"'()[]{}", b"-_/\\", b":;=+^~`"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _k
_CLASS[128:] = 0  # bytes of letters beyond ASCII
N_CLASSES = len(_GROUPS) + 1
_SHARES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45, 0.7])
_BINNED = 4
N_BINS = 24
N_TERMS = N_CLASSES * N_CLASSES + _BINNED * N_BINS
BIN_WEIGHT = 0.6


def terms(text: str | None) -> np.ndarray:
    """Weights of a text's terms: square roots of the shares of class pairs, and one bin of each count."""
    raw = (text or "").encode()
    out = np.zeros(N_TERMS)
    of = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(of) > 1:
        pairs = np.bincount(of[:-1] * N_CLASSES + of[1:], minlength=N_CLASSES * N_CLASSES)
        out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / (len(of) - 1))
    counts = np.bincount(of, minlength=N_CLASSES) if len(of) else np.zeros(N_CLASSES, np.int64)
    words = raw.split()
    n = len(words)
    triples = max(0, n - 2)
    repeated = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples else 0.0
    marks = counts[8] + counts[10:19].sum()
    shares = (repeated, min(1.0, marks / max(1, 4 * n)), counts[1] / max(1, counts[0] + counts[1]))
    bins = [min(N_BINS - 1, n if n < 10 else 6 + int(np.log2(n))), *(int(np.searchsorted(_SHARES, s)) for s in shares)]
    for k, b in enumerate(bins):
        out[N_CLASSES * N_CLASSES + k * N_BINS + b] = BIN_WEIGHT
    return out


@dataclass(frozen=True)
class Model:
    """Term weights, the projection to latent dimensions, and the labelled latent vectors of length 1."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        weighted = rows * self.weights
        weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
        out = weighted @ self.projection
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        near = self.latent(rows) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, at, axis=1), 1e-6, 1) ** POWER
        return np.clip((weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def _frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs; summed in the tasks, then by term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(N_TERMS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += terms(t) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"term": pa.array([*range(N_TERMS), -1], pa.int32()), "n": pa.array([*total.tolist(), n], pa.int64())})

    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    rows = texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # N_TERMS + 1 rows
    found = {r.term: r.n for r in rows}
    return np.array([found.get(k, 0) for k in range(N_TERMS)]), found.get(-1, 0)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
    label_id: str = "doc_id", sample: int = SAMPLE, dimensions: int = DIMENSIONS,
) -> Model:
    """A model from labelled rows, at most ``sample`` of them; labels is joined on its id column."""
    found, n_docs = _frequencies(docs, text)
    weights = np.log((1 + n_docs) / (1 + found)) + 1
    named = labels.select(F.col(f"`{label_id}`").alias("__id"), F.col(f"`{label}`").cast("double").alias("__y")).where("__y IS NOT NULL")
    texts = docs.select(F.col(f"`{doc_id}`").alias("__doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def to_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t).astype("<f4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["terms", "y"])

    # first the hashes of all labelled texts, of which the smallest are taken; texts themselves only for those
    hashed = texts.select("__doc", F.xxhash64("text").alias("h"))
    chosen = hashed.join(named, F.col("__doc") == F.col("__id")).orderBy("h", "__y", "__doc").limit(sample).select("__id", "__y")
    picked = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "__y")
    rows = picked.mapInArrow(to_terms, "terms binary, y double").collect()  # at most ``sample`` rows of fixed size
    rows.sort(key=lambda r: (r.terms, r.y))
    if not rows:
        return Model(weights, np.zeros((N_TERMS, 1)), np.zeros((0, 1)), np.zeros(0))
    table = np.array([np.frombuffer(r.terms, "<f4") for r in rows], dtype=float)
    weighted = table * weights
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh(weighted.T @ weighted)  # right singular vectors, by ascending singular value
    projection = vectors[:, ::-1][:, : min(dimensions, len(rows))]
    model = Model(weights, projection, np.zeros((0, 1)), np.zeros(0))
    return Model(weights, projection, model.latent(table), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(*[c for c in ["score"] if c != text])
    carried = [f for f in plain.schema.fields if f.name != "score"]
    source = plain.select(*[F.col(f"`{f.name}`").alias(f"c_{i}") for i, f in enumerate(carried)], F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(a, BLOCK_DOCS)
                rows = np.array([terms(t) for t in batch.column("text").to_pylist()])
                columns = [batch.column(f"c_{i}") for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.round(fitted.scores(rows), 9))], [*(f.name for f in carried), "score"])

    return source.mapInArrow(run, StructType([*carried, StructField("score", DoubleType())]))
