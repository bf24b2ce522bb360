"""Batches of texts cut into cells, each distinct cell told apart once.

A batch is one array of code points. The caller marks where cells start; equal cells get one code, and values
made once per distinct cell are laid out again in the order of the batch, so that a text's values are one
range of bytes. Memory grows with the batch; nothing is kept between batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def code_points(texts: list[str], gap: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts with a gap between them, and the place of each text's first one."""
    sizes = np.fromiter((len(t) + len(gap) for t in texts), np.int64, len(texts))
    return np.frombuffer(gap.join(texts).encode("utf-32-le"), "<u4"), np.cumsum(sizes) - sizes


def distinct(points: np.ndarray, first: np.ndarray) -> tuple[pa.Array, list[str]]:
    """The code of every cell and the cell of every code; a cell goes from one place in ``first`` to the next."""
    raw = points.tobytes().decode("utf-32-le").encode()
    at = first
    if len(raw) != len(points):  # bytes beyond the first of a character come after it
        beyond = np.flatnonzero(points >= 0x80)
        sizes = 1 + (points[beyond] >= 0x800).astype(np.int64) + (points[beyond] >= 0x10000)
        at = first + np.append(0, np.cumsum(sizes))[np.searchsorted(beyond, first)]
    offsets = np.append(at, len(raw)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
    return coded.indices, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def laid_out(values: list[bytes], codes: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values of all cells, one after the other, and the offsets where each begins, then the end."""
    taken = pc.take(pa.array(values, pa.large_binary()), codes)
    _, offsets, data = taken.buffers()
    return memoryview(data or b""), np.frombuffer(offsets, np.int64, len(taken) + 1, taken.offset * 8) if offsets else np.zeros(1, np.int64)
