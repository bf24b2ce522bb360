"""Memory that a batch of texts takes while it is encoded."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from tallyweir.llm import pieces


def test_pieces_of_a_large_batch_take_bounded_memory():
    random.seed(31)
    words = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(300)]
    texts = pa.array([" ".join(random.choices(words, k=400)) for _ in range(3000)])
    batch = pa.RecordBatch.from_arrays([texts], ["__text"])
    model = pieces.PieceModel(pieces.default_model_path())
    model.learn(model.chunks_of([texts[0].as_py()])[1])
    tracemalloc.start()
    try:
        n = sum(len(pieces._digests(model, part.column("__text").to_pylist())) for part in pieces._in_slices(batch, batch.column("__text")))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 3000 and texts.nbytes > 5 << 20
    assert peak < 40 << 20
    assert all(isinstance(kept, bytes) for kept in model.chunks.values())
