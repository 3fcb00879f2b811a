"""Words of whole Arrow batches as flat arrays; shared by the operators that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# word bytes: digits, lower-case letters and everything outside ASCII
_WORD = np.ones(256, dtype=bool)
_WORD[0x00:0x30] = False
_WORD[0x3A:0x61] = False
_WORD[0x7B:0x80] = False


def slabs(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each; a row is never split."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    slab = (np.cumsum(sizes) - sizes) // max_bytes
    cuts = np.flatnonzero(np.diff(slab)) + 1
    yield from zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(texts)].tolist(), strict=True)


def split_words(texts: pa.Array, fold: str = "ascii") -> tuple[pa.StringArray, np.ndarray]:
    """All words of a batch in order, and the number of words of each row.

    ``fold`` lower-cases A-Z only (``ascii``) or every letter (``unicode``).  A null has no
    words.  Words are maximal runs of digits, lower-case ASCII letters and other characters
    outside ASCII.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.ascii_lower(texts) if fold == "ascii" else pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets.astype(np.int64) - offsets[0]
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]  # a word ends with its row
    starts = np.flatnonzero(first)
    letters = np.cumsum(inside)
    bounds = np.r_[letters[starts] - 1, letters[-1]] if len(starts) else np.zeros(1, dtype=np.int64)
    words = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data[inside].tobytes())
    )
    return words, np.diff(np.searchsorted(starts, offsets))
