"""Encoding by distinct chunks: texts are cut where no token can cross, each distinct chunk is encoded once per
worker, and whole texts are put together from the results in array operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

Encoder = Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]  # flat ids, ids by chunk


class ChunkTable:
    """Ids of distinct chunks, kept from batch to batch and dropped when there are too many."""

    def __init__(self, encode: Encoder, limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.int32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)

    def _add(self, chunks: list[str]) -> None:
        n = len(self.number)
        at = int(self.ends[n - 1]) if n else 0
        flat, sizes = self.encode(chunks)
        total = at + len(flat)
        while total > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while n + len(chunks) > len(self.ends):
            self.ends = np.r_[self.ends, np.zeros_like(self.ends)]
        self.ids[at:total] = flat
        self.ends[n : n + len(chunks)] = at + np.cumsum(sizes)
        self.number.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def flat_ids(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in order, and their number by chunk."""
        if not len(chunks):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) > self.limit:
            self._clear()
        numbers = list(map(self.number.get, distinct))
        new = [c for c, k in zip(distinct, numbers, strict=True) if k is None]
        if new:
            self._add(new)
            numbers = list(map(self.number.get, distinct))
        own = np.array(numbers, dtype=np.int64)
        ends = self.ends[own]
        starts = np.where(own > 0, self.ends[np.maximum(own - 1, 0)], 0)
        codes = coded.indices.to_numpy().astype(np.intp)
        sizes = (ends - starts).take(codes)
        before = np.cumsum(sizes) - sizes
        pick = np.repeat(starts.take(codes) - before, sizes)
        pick += np.arange(len(pick))
        return self.ids.take(pick), sizes


def split_at(texts: pa.Array, breaks: np.ndarray, drop: bytes = b"") -> tuple[pa.StringArray, np.ndarray]:
    """Chunks of a batch of texts without nulls, and the number of chunks of each text.

    ``breaks[x, y]`` says that a chunk ends between the bytes x and y; bytes of ``drop`` belong
    to no chunk.  A chunk also ends with its text.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets.astype(np.int64) - offsets[0]
    first = np.ones(len(data), dtype=bool)
    first[1:] = breaks.ravel()[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    if drop:
        inside = ~np.isin(data, np.frombuffer(drop, dtype=np.uint8))
        first[1:] |= ~inside[:-1]
        first &= inside
        letters = np.cumsum(inside)
        starts = np.flatnonzero(first)
        bounds, body = np.r_[letters[starts] - 1, letters[-1]], data[inside]
    else:
        starts = np.flatnonzero(first)
        bounds, body = np.r_[starts, len(data)], data
    chunks = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())
    )
    return chunks, np.diff(np.searchsorted(starts, offsets))


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` values; an empty group has 0."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
