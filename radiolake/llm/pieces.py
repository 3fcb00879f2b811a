"""Merge-type SentencePiece encoding and decoding by a score-ordered agenda of adjacent pairs.

A text gets a leading space, and spaces become the space mark.  Merges never cross two
neighbouring characters that no piece holds next to each other: a text is cut there, and every
distinct chunk is merged once per worker.  In a chunk all adjacent symbol pairs
that form a piece wait in an agenda ordered by the piece's score, leftmost first among equals;
the best is merged and its new neighbours join the agenda.  Characters left without a piece
become their UTF-8 bytes.  The first time a chunk is met, its ids are compared with those of the
sentencepiece library; ``agrees`` tells whether all chunks of a text did.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.chunks import ChunkTable, split_at, sums_by
from radiolake.llm.words import slabs

MARK = "▁"


class PieceModel:
    """Pieces, scores and bytes of a merge-type vocabulary file."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.bytes: list[bytes] = []  # what each id decodes to, with marks as spaces
        self.number: dict[str, int] = {}
        self.order: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.marked = np.zeros(size, dtype=bool)
        self.is_byte = np.zeros(size, dtype=bool)
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                self.is_byte[i] = True
            elif lib.is_control(i):
                self.bytes.append(b"")
            elif lib.is_unknown(i):
                self.unknown = i
                self.bytes.append(" ⁇ ".encode())
            else:
                self.number[piece] = i
                self.order[piece] = -lib.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
                self.marked[i] = piece.startswith(MARK)
        # pairs of bytes that no piece holds, the second one the first of a character
        self.breaks = np.ones((256, 256), dtype=bool)
        self.breaks[:, 0x80:0xC0] = False
        for data in self.bytes:
            held = np.frombuffer(data, dtype=np.uint8)
            self.breaks[held[:-1], held[1:]] = False
        if not self.breaks[10].all(where=np.arange(256) < 0x80):
            raise ValueError("a vocabulary with pieces that hold line feeds is not supported")
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk, in which spaces stand for marks."""
        symbols = list(chunk.replace(" ", MARK))
        merged = self._merge_short(symbols) if len(symbols) <= 48 else self._merge_long(symbols)
        number, ids = self.number, []
        for symbol in merged:
            known = number.get(symbol)
            if known is not None:
                ids.append(known)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in symbol.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The agenda is a list by place; its best entry is looked for."""
        order, never = self.order.get, math.inf
        agenda = [order(a + b, never) for a, b in pairwise(symbols)]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            pair = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [pair]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = order(pair + symbols[i + 1], never)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + pair, never)
        return symbols

    def _merge_long(self, symbols: list[str | None]) -> list[str]:
        """The agenda is a heap; entries whose symbols have changed are passed over."""
        order = self.order
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in order:
                agenda.append((order[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = pair + symbols[k]
                if right in order:
                    heapq.heappush(agenda, (order[right], i, right))
            h = before[i]
            if h >= 0:
                left = symbols[h] + pair
                if left in order:
                    heapq.heappush(agenda, (order[left], h, left))
        return [x for x in symbols if x is not None]

    def merge_all(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the chunks, and their number by chunk.  In front of each chunk's ids
        stands whether the library gives the same."""
        ours = [self.merge(c) for c in chunks]
        # the library puts a space mark in front; behind a line feed no merge reaches the chunk
        theirs = self.library.encode(["\n" + c for c in chunks], num_threads=1)
        flat = [i for a, b in zip(ours, theirs, strict=True) for i in (a == b[2:], *a)]
        return np.array(flat, dtype=np.int32), np.fromiter(map(len, ours), dtype=np.int64, count=len(ours)) + 1

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.StringArray:
        """Texts of consecutive groups of ids: marks become spaces, bytes join to characters
        (each byte that fits none becomes U+FFFD), and the leading space is taken off."""
        sizes = self.lengths[ids].copy()
        starts = self.starts[ids].copy()
        head = (np.cumsum(counts) - counts)[counts > 0]
        head = head[self.marked[ids[head]]]
        sizes[head] -= 1
        starts[head] += 1
        before = np.cumsum(sizes) - sizes
        pick = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        bounds = np.r_[0, np.cumsum(sums_by(sizes, counts))].astype(np.int32)
        data = self.data[pick].tobytes()
        texts = pa.StringArray.from_buffers(len(counts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data))
        if self.is_byte[ids].any():
            texts = pa.array([_decode_bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
        return texts


def _decode_bytes(data: bytes) -> str:
    """UTF-8 in which every byte that belongs to no character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out = data.decode(errors="surrogateescape")
        return "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in out)


_MODELS: dict[str, tuple[PieceModel, ChunkTable]] = {}  # one per worker and file


def _model(path: str) -> tuple[PieceModel, ChunkTable]:
    if path not in _MODELS:
        model = PieceModel(path)
        _MODELS[path] = (model, ChunkTable(model.merge_all, limit=200_000))
    return _MODELS[path]


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids of a batch, ids by text, and whether the library agrees; a null is empty."""
    model, table = _model(path)
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")  # both stand for a mark
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    chunks, counts = split_at(texts, model.breaks)
    flat, sizes = table.flat_ids(chunks)
    flags = np.zeros(len(flat), dtype=bool)
    flags[np.cumsum(sizes) - sizes] = True  # each chunk's ids follow its flag
    agrees = sums_by(flat[flags], counts) == counts
    return flat[~flags], sums_by(sizes - 1, counts), agrees


def encode(
    docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """All columns of ``docs``, then ``ids_col`` (array of int) and ``agrees`` (boolean), and
    with ``decoded_col`` also the text that the ids decode to.

    A null or empty text has no ids and decodes to an empty text.  Columns with these names are
    replaced, unless it is the text column that they would replace.
    """
    new = [ids_col, "agrees", *([decoded_col] if decoded_col else [])]
    names = [c for c in docs.columns if c not in new]
    rows = docs.select(*names, F.col(text_col).alias("__text"))
    schema = docs.select(
        *names,
        F.array().cast("array<int>").alias(ids_col),
        F.lit(True).alias("agrees"),
        *([F.lit("").alias(decoded_col)] if decoded_col else []),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(path)
        for batch in batches:
            for lo, hi in slabs(batch.column("__text"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                ids, counts, agrees = encode_texts(part.column("__text"), path)
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                columns = [pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(agrees)]
                if decoded_col:
                    columns.append(model.decode(ids, counts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=[*names, *new])

    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of ``coded``, then ``text_col``; a null list is empty."""
    names = [c for c in coded.columns if c != text_col]
    schema = coded.select(*names, F.lit("").alias(text_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(path)
        for batch in batches:
            lists = batch.column(ids_col)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = model.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, text_col])

    return coded.select(*names).mapInArrow(run, schema)
