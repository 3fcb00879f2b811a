"""Blocks of token ids under an adaptive context-mixing range coder.

A block is self-contained: the model starts afresh, and a checksum covers the coded body and
another the decoded ids.  The ids of a block are dealt to lanes, contiguous stretches of equal
length; all lanes code their next id in the same step with the same model, in whole-array numpy
operations, and the model then learns from the step's ids.

The model predicts the next id at three orders.  Order 2 and order 1 each name one id (the last
successor of the two ids, or one id, before it) with a confidence; order 0 is a distribution over
all ids.  Two experts say how likely each order is right, one from the two confidences, one from
the previous id; they are mixed by their recent success.  The mixture is one cumulative table,
so an id costs one step of the range coder: 12 bits choose the order, 18 bits the id within
order 0.  All arithmetic is on integers, so any machine decodes what another has coded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMRC"
_HEAD = struct.Struct("<4sHHIIIIII")  # magic, version, lanes, vocabulary, ids, rows, words, crc of body, crc of ids
_ORDER_BITS, _ID_BITS, _HASH_BITS = 12, 18, 18
_BITS = np.uint64(_ORDER_BITS + _ID_BITS)
_WORD = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)
_FULL = 1 << _ORDER_BITS
_SURE = 7  # largest confidence


class CorruptBlock(ValueError):
    """A checksum or a length of a block does not fit."""


class _Model:
    """Predictions packed as ``id << 3 | confidence``; shares and masses in 1/4096."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.by1 = np.zeros(vocabulary + 1, dtype=np.int32)
        self.by2 = np.zeros(1 << _HASH_BITS, dtype=np.int32)
        # expert by confidences: counts of (order 2 right, order 1 right, neither)
        self.seen = np.tile(np.array([1, 1, 2], dtype=np.int64), ((_SURE + 1) ** 2, 1))
        # expert by previous id: shares of order 2 and order 1
        self.own2 = np.full(vocabulary + 1, _FULL // 8, dtype=np.int32)
        self.own1 = np.full(vocabulary + 1, _FULL // 8, dtype=np.int32)
        self.success = [1 << 16, 1 << 16]
        self.last1 = np.full(lanes, vocabulary, dtype=np.intp)
        self.last2 = np.full(lanes, vocabulary, dtype=np.intp)
        self.counts = np.zeros(vocabulary, dtype=np.int64)
        self.pending: list[np.ndarray] = []
        self.fresh, self.total, self.step = 0, 0, 0
        self._order0()
        self._experts()

    def _order0(self) -> None:
        """Order-0 frequencies that add up to 2**18, each at least 1."""
        room = (1 << _ID_BITS) - self.vocabulary
        total = max(1, int(self.counts.sum()))
        f = 1 + self.counts * room // total
        f[0] += (1 << _ID_BITS) - int(f.sum())
        self.freq = f.astype(np.int32)
        self.start = (np.cumsum(f) - f).astype(np.int32)
        self.at: np.ndarray | None = None

    def _experts(self) -> None:
        """Shares by the confidences, and both experts' weights in the mixture."""
        shares = self.seen * (_FULL - 64) // self.seen.sum(axis=1, keepdims=True)
        self.shares = shares.astype(np.int32)
        x, y = self.success
        self.weight = y * _FULL // (x + y)
        mixed = (self.shares * (_FULL - self.weight) >> _ORDER_BITS).astype(np.int32) + 1
        self.mixed2, self.mixed1 = np.ascontiguousarray(mixed[:, 0]), np.ascontiguousarray(mixed[:, 1])

    def predict(self, n: int) -> None:
        """Masses of the orders for the next id of the first ``n`` lanes."""
        self.a = a = self.last1[:n]
        self.h = h = ((self.last2[:n] * 0x9E3779B1 + a * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - _HASH_BITS)
        self.v2, self.v1 = self.by2.take(h), self.by1.take(a)
        self.k2, self.k1 = self.v2 & _SURE, self.v1 & _SURE
        self.q2, self.q1 = self.v2 >> 3, self.v1 >> 3
        self.context = ((self.k2 << 3) | self.k1).astype(np.intp)
        self.o2, self.o1 = self.own2.take(a), self.own1.take(a)
        weight = np.int32(self.weight)
        m2 = self.mixed2.take(self.context) + (self.o2 * weight >> _ORDER_BITS)
        m1 = self.mixed1.take(self.context) + (self.o1 * weight >> _ORDER_BITS)
        self.m2 = m2 * (self.k2 > 0)
        self.m1 = m1 * ((self.k1 > 0) & ((self.k2 == 0) | (self.q1 != self.q2)))
        self.both = self.m2 + self.m1
        self.m0 = _FULL - self.both  # at least 62: both experts leave 64

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id out of 2**30."""
        self.two = two = (ids == self.q2) & (self.m2 > 0)
        self.one = one = (ids == self.q1) & (self.m1 > 0) & ~two
        start = np.where(one, self.m2, self.both) * ~two << _ID_BITS
        width = np.where(two, self.m2, self.m1) << _ID_BITS
        self.plain = plain = np.flatnonzero(~(two | one))
        m0, own = self.m0.take(plain), ids.take(plain)
        start[plain] += m0 * self.start.take(own)
        width[plain] = m0 * self.freq.take(own)
        return start, width

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose interval holds the value."""
        if self.at is None:
            self.at = np.repeat(np.arange(self.vocabulary, dtype=np.int32), self.freq)
        order = value >> _ID_BITS
        ids = np.where(order < self.m2, self.q2, self.q1)
        plain = np.flatnonzero(order >= self.both)
        inner = (value.take(plain) - (self.both.take(plain) << _ID_BITS)) // self.m0.take(plain)
        ids[plain] = self.at.take(inner, mode="clip")
        return ids

    def learn(self, ids: np.ndarray) -> None:
        """Take in the ids of a step; the experts by previous id learn in every other step."""
        a, two, one = self.a, self.two, self.one
        order = 2 - one - 2 * two.view(np.int8)
        cells = self.context * 3
        cells += order
        self.seen += np.bincount(cells, minlength=self.seen.size).reshape(self.seen.shape)
        self.step += 1
        if self.step % 8 == 0:
            if int(self.seen.max()) > 1 << 20:
                self.seen = (self.seen >> 1) + 1
            t2, t1 = self.shares[self.context, 0], self.shares[self.context, 1]
            right_t = np.where(two, t2, np.where(one, t1, _FULL - t2 - t1))
            right_o = np.where(two, self.o2, np.where(one, self.o1, _FULL - self.o2 - self.o1))
            new = (int(right_t.sum()) // len(ids) + 1, int(right_o.sum()) // len(ids) + 1)
            self.success = [s - (s >> 3) + x for s, x in zip(self.success, new, strict=True)]
            self._experts()
        if self.step % 2:
            for own, seen, right in ((self.own2, self.o2, two), (self.own1, self.o1, one)):
                own[a] = seen + ((np.where(right, np.int32(_FULL - 448), np.int32(64)) - seen) >> 3)
        fresh = (ids << 3) | 1
        for table, index, v, k, said in (
            (self.by2, self.h, self.v2, self.k2, self.q2),
            (self.by1, a, self.v1, self.k1, self.q1),
        ):
            right = (said == ids) & (k > 0)
            table[index] = np.where(right, v + (k < _SURE), np.where(k > 1, v - k + (k >> 1), fresh))
        self.last2[: len(ids)] = a
        self.last1[: len(ids)] = ids
        self.pending.append(ids)
        self.fresh += len(ids)
        if self.fresh >= max(4096, self.total >> 3):
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.vocabulary)
            self.total += self.fresh
            self.pending, self.fresh = [], 0
            self._order0()


def _lanes(n: int) -> int:
    """Lanes of a block of n ids: about 128 ids or more each, 8192 lanes at most."""
    return 1 << min(13, max(0, (n // 128).bit_length() - 1))


def _renormal(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose upper word is settled (or has to be, their span being small); mends spans."""
    same = ((low ^ (low + span)) >> _WORD) == 0
    small = (span >> _WORD) == 0
    cut = np.flatnonzero(small & ~same)
    if len(cut):
        span[cut] = (np.uint64(0) - low[cut]) & _LOW32
    return np.flatnonzero(same | small)


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, bytes]:
    """(lanes, body) of an array of ids below ``vocabulary`` (at most 2**17)."""
    if not 0 < vocabulary <= 1 << 17:
        raise ValueError("the vocabulary must have 1 to 131072 ids")
    ids = ids.astype(np.int32)
    n = len(ids)
    lanes = _lanes(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)  # the last lane may end early, later ones may be empty
    length = np.clip(n - np.arange(lanes) * steps, 0, steps)
    model = _Model(vocabulary, lanes)
    low = np.zeros(lanes, dtype=np.uint64)
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    lane_of: list[np.ndarray] = []
    words: list[np.ndarray] = []
    for t in range(steps):
        m = int(np.count_nonzero(length > t))  # lengths never rise
        now = grid[t, :m]
        model.predict(m)
        start, width = model.interval(now)
        part = span[:m] >> _BITS
        low[:m] += start.astype(np.uint64) * part
        span[:m] = width.astype(np.uint64) * part
        out = _renormal(low[:m], span[:m])
        if len(out):
            lane_of.append(out)
            words.append((low[out] >> _WORD).astype(np.uint32))
            low[out] <<= _WORD
            span[out] <<= _WORD
        model.learn(now)
    last = np.flatnonzero(length > 0)
    lane_of.append(last)
    words.append(((low[last] + _LOW32) >> _WORD).astype(np.uint32))  # a span holds a multiple of 2**32
    lane = np.concatenate(lane_of)
    order = np.argsort(lane, kind="stable")
    counts = np.bincount(lane, minlength=lanes).astype("<u4")
    return lanes, counts.tobytes() + np.concatenate(words)[order].astype("<u4").tobytes()


def decode_ids(body: bytes, n: int, lanes: int, vocabulary: int) -> np.ndarray:
    steps = -(-n // lanes)
    counts = np.frombuffer(body, dtype="<u4", count=lanes).astype(np.int64)
    words = np.frombuffer(body, dtype="<u4", offset=4 * lanes)
    if int(counts.sum()) != len(words):
        raise CorruptBlock("the lanes do not add up")
    words = np.r_[words, np.zeros(2, dtype=np.uint32)].astype(np.uint64)
    end = np.cumsum(counts)
    at = end - counts

    def take(lane: np.ndarray) -> np.ndarray:
        got = np.where(at[lane] < end[lane], words[at[lane]], np.uint64(0))
        at[lane] += 1
        np.minimum(at, len(words) - 1, out=at)
        return got

    length = np.clip(n - np.arange(lanes) * steps, 0, steps)
    model = _Model(vocabulary, lanes)
    every = np.arange(lanes)
    low = np.zeros(lanes, dtype=np.uint64)
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    code = take(every) << _WORD
    code |= take(every)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    for t in range(steps):
        m = int(np.count_nonzero(length > t))
        model.predict(m)
        part = span[:m] >> _BITS
        value = np.minimum((code[:m] - low[:m]) // part, np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
        now = model.find(value)
        start, width = model.interval(now)
        grid[t, :m] = now
        low[:m] += start.astype(np.uint64) * part
        span[:m] = width.astype(np.uint64) * part
        out = _renormal(low[:m], span[:m])
        if len(out):
            low[out] <<= _WORD
            span[out] <<= _WORD
            code[out] = (code[out] << _WORD) | take(out)
        model.learn(now)
    return grid.T.ravel()[:n]


def pack_block(ids: np.ndarray, rows: bytes, n_rows: int, vocabulary: int) -> bytes:
    """A block of ids with ``rows`` (a caller's table of what they belong to)."""
    lanes, body = encode_ids(ids, vocabulary) if len(ids) else (1, b"\0\0\0\0")
    body = zlib.compress(rows, 1) + body
    packed = len(body)
    head = _HEAD.pack(
        MAGIC, 1, lanes, vocabulary, len(ids), n_rows, packed, zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())
    )
    return head + body


def unpack_block(block: bytes) -> tuple[np.ndarray, bytes, int]:
    """(ids, rows, number of rows); raises CorruptBlock where a checksum or length is wrong."""
    if len(block) < _HEAD.size:
        raise CorruptBlock("the block is cut short")
    magic, version, lanes, vocabulary, n, n_rows, size, body_crc, ids_crc = _HEAD.unpack_from(block)
    body = block[_HEAD.size :]
    if magic != MAGIC or version != 1 or len(body) != size or zlib.crc32(body) != body_crc:
        raise CorruptBlock("the block's body does not fit its header")
    unzip = zlib.decompressobj()
    rows = unzip.decompress(body)
    ids = decode_ids(unzip.unused_data, n, lanes, vocabulary) if n else np.zeros(0, dtype=np.int32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise CorruptBlock("the ids do not fit their checksum")
    return ids, rows, n_rows
