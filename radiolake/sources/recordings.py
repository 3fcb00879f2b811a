"""Recordings as a data source: ``spark.read.format("radio_iq")`` and ``spark.readStream``.

Options: ``path`` (a recording, a folder, or a pattern in its last part), ``chunk_samples`` or
``chunk_sec`` (0.1), ``rate_hz``, ``center_hz``, ``dtype``, ``header_bytes``, ``scale``, ``channel_id``,
``task_bytes`` (128 MB).  Rows are those of ``iq_chunks`` over the valid recordings of
``capture_catalog``; faulty ones are left to the catalogue.

The driver lists names and sizes only.  A task opens its recording, plans the chunks of its share
and reads those by byte range that the filters on path and positions leave (they need
``spark.sql.python.filterPushdown.enabled``; without it Spark filters what was read).

As a stream a folder is a series of rolling recordings in order of name, the last of which may
still grow.  The offset is the newest recording and how many of its chunks were given out, so a
restart goes on with the next chunk.  Only whole chunks of the last recording are given out; its
short last one comes when a later recording exists, or at once with ``complete`` = true.  A
recording that turns up before the offset is an error, not a silent loss.

With ``replay`` (``once``, ``continuous-test``, ``epoch-repeat``), ``loops`` and ``silence_samples`` the
stream is the timeline of ``replay_timeline``, one for each recording, and the offset a chunk
number on it.  ``start_time`` (seconds of the epoch) paces it by the clock times ``speed``;
without it all is there at once.
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from radiolake.sources import files as S

_ORDERED = {
    D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b,
    D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.In: lambda a, b: a in b,
}
_PLANNED = ("sequence_number", "start_sample", "end_sample")
_REPLAY = ", loop_index long, is_silence boolean, file_sample_start long"
_MODES = ("once", "continuous-test", "epoch-repeat")


def list_files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the recordings below a path, in order of name."""
    from pyarrow import fs

    head, _, last = path.rstrip("/").rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    system, inner = S.locate(head if pattern else path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=pattern is None))
    return sorted(
        (scheme + f.path, f.size) for f in found
        if f.is_file and not f.base_name.startswith((".", "_")) and (pattern is None or fnmatch.fnmatch(f.base_name, pattern))
    )


@dataclass
class Share(D.InputPartition):
    """Chunks ``first`` to before ``last`` of a recording, or share ``part`` of ``parts`` of it where
    its length is not known yet; ``loop`` and ``silence`` place it on a timeline."""

    path: str
    size: int
    part: int = 0
    parts: int = 1
    first: int | None = None
    last: int | None = None
    loop: int = 0
    silence: bool = False


class _Options:
    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        number = lambda k, kind=float: kind(o[k]) if o.get(k) else None
        if "path" not in o:
            raise ValueError("a path is required")
        self.path = o["path"]
        self.chunk_samples, self.chunk_sec = number("chunk_samples", int), number("chunk_sec") or 0.1
        self.scale, self.channel_id = number("scale"), number("channel_id", int) or 1
        self.task_bytes = number("task_bytes", int) or 128 << 20
        self.describe = {
            "rate_hz": number("rate_hz"), "center_hz": number("center_hz"), "dtype": o.get("dtype", "int16").lower(),
            "header_bytes": number("header_bytes", int) or 0,
        }
        self.replay, self.loops = o.get("replay"), number("loops", int) or 1
        self.silence = number("silence_samples", int) or 0
        self.start_time, self.speed = number("start_time"), number("speed") or 1.0
        self.complete = o.get("complete", "false").lower() == "true"
        if self.scale is not None and (self.scale == 0 or not np.isfinite(self.scale)):
            raise ValueError("scale must be finite and not zero")
        if (self.chunk_samples is not None and self.chunk_samples < 1) or self.chunk_sec <= 0:
            raise ValueError("chunks need at least one sample")
        if self.replay is not None:
            if self.replay not in _MODES:
                raise ValueError(f"unknown replay mode {self.replay}")
            if self.replay == "once" and self.loops != 1:
                raise ValueError("replay mode once plays one loop")
            if self.replay == "epoch-repeat" and self.silence <= 0:
                raise ValueError("epoch-repeat needs silence between loops")

    def capture(self, path: str, size: int) -> SimpleNamespace | None:
        """What a recording is and how it is cut, None for a faulty one."""
        row = S._describe(path, size, S.named_rate(path), self.describe)
        if row["error"] is not None:
            return None
        n = self.chunk_samples or max(1, int(row["sample_rate_hz"] * self.chunk_sec + 0.5))
        return SimpleNamespace(**row, n=n, chunks=-(-row["total_samples"] // n))

    def shares(self, path: str, size: int, first: int, last: int, bytes_each: int, **place) -> list[Share]:
        """A range of chunks in tasks of about ``task_bytes``."""
        step = max(1, self.task_bytes // max(1, bytes_each))
        return [Share(path, size, first=a, last=min(a + step, last), **place) for a in range(first, last, step)]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, out = 0, []
    for row in rows:
        out.append(row)
        held += 8 * len(row[12])
        if held >= S.BATCH_BYTES:
            yield _batch(out, schema)
            held, out = 0, []
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {
        "string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32()),
    }
    return pa.schema([pa.field(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _planned(cap: SimpleNamespace, first: int, last: int) -> Iterator[SimpleNamespace]:
    for k in range(first, last):
        end = min((k + 1) * cap.n, cap.total_samples)
        yield SimpleNamespace(**(vars(cap) | {"sequence_number": k, "start_sample": k * cap.n, "end_sample": end}))


class RecordingReader(D.DataSourceReader):
    def __init__(self, options: _Options):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _ORDERED and (column in _PLANNED or (column == "path" and type(f) in (D.EqualTo, D.In))):
                self.tests.append((column, _ORDERED[type(f)], f.value))
            else:
                yield f

    def _passes(self, names: tuple[str, ...], row) -> bool:
        return all(test(getattr(row, c), v) for c, test, v in self.tests if c in names)

    def partitions(self) -> Sequence[Share]:
        found = [(p, n) for p, n in list_files(self.options.path) if self._passes(("path",), SimpleNamespace(path=p))]
        out = []
        for path, size in found:
            parts = max(1, -(-size // self.options.task_bytes))
            out += [Share(path, size, k, parts) for k in range(parts)]
        return out or [Share("", 0)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        cap = self.options.capture(share.path, share.size) if share.path else None
        if cap is None:
            return
        first, last = cap.chunks * share.part // share.parts, cap.chunks * (share.part + 1) // share.parts
        wanted = [r for r in _planned(cap, first, last) if self._passes(_PLANNED, r)]
        if not wanted:
            return
        with S._open(share.path) as f:
            rows = (S.read_chunk(f, r, self.options.scale, self.options.channel_id) for r in wanted)
            yield from _batches(rows, _arrow(S.CHUNKS))


class RollingReader(D.DataSourceStreamReader):
    """Recordings of a folder in order of name, as they grow."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"file": "", "files": 0, "chunks": 0}

    def latestOffset(self) -> dict:
        try:
            found = list_files(self.options.path)
        except FileNotFoundError:
            found = []
        if not found:
            return self.initialOffset()
        path, size = found[-1]
        chunks = self._ready(path, self._whole(path, size), self.options.complete)
        return {"file": path, "files": len(found), "chunks": chunks}

    def _whole(self, path: str, size: int) -> int:
        """Bytes of whole samples, as a recording may be being written."""
        o = self.options.describe
        if path.lower().endswith(".bvsp"):
            return size - max(0, size - 112) % 4
        if S._is_wav(path, size):
            return size
        return size - max(0, size - o["header_bytes"]) % (2 * S.SCALAR_BYTES.get(o["dtype"], 1))

    def _ready(self, path: str, size: int, ended: bool) -> int:
        """Chunks of a recording that will not change."""
        cap = self.options.capture(path, size)
        if cap is None:
            return 0
        return cap.chunks if ended else cap.total_samples // cap.n

    def partitions(self, start: dict, end: dict) -> Sequence[Share]:
        found = [(p, n) for p, n in list_files(self.options.path) if p <= end["file"]]
        known = sum(p <= start["file"] for p, _ in found)
        if known != start["files"] or len(found) != end["files"]:
            raise ValueError(f"recordings appeared or went at or before {end['file']}, which the stream has passed")
        out = []
        for path, size in found[max(0, known - 1) :]:
            size = self._whole(path, size)
            first = start["chunks"] if path == start["file"] else 0
            last = end["chunks"] if path == end["file"] else self._ready(path, size, True)
            cap = self.options.capture(path, size) if last > first else None
            if cap is not None:
                out += self.options.shares(path, size, first, last, cap.n * cap.frame_bytes)
        return out

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        cap = self.options.capture(share.path, share.size)
        with S._open(share.path) as f:
            rows = (S.read_chunk(f, r, self.options.scale, self.options.channel_id) for r in _planned(cap, share.first, share.last))
            yield from _batches(rows, _arrow(S.CHUNKS))


class ReplayReader(D.DataSourceStreamReader):
    """The timelines of a fixed set of recordings, side by side."""

    def __init__(self, options: _Options):
        self.options = options
        self.gap = options.silence if options.replay == "epoch-repeat" else 0

    def _captures(self) -> list[tuple[str, int, SimpleNamespace]]:
        found = [(p, n, self.options.capture(p, n)) for p, n in list_files(self.options.path)]
        return [x for x in found if x[2] is not None]

    def _quiet(self, cap: SimpleNamespace) -> int:
        return -(-self.gap // cap.n)

    def _length(self, cap: SimpleNamespace) -> int:
        return self.options.loops * cap.chunks + (self.options.loops - 1) * self._quiet(cap)

    def initialOffset(self) -> dict:
        return {"chunks": 0}

    def latestOffset(self) -> dict:
        o, captures = self.options, self._captures()
        total = max((self._length(c) for _, _, c in captures), default=0)
        if o.start_time is None or not captures:
            return {"chunks": total}
        per_sec = min(c.sample_rate_hz / c.n for _, _, c in captures)
        return {"chunks": min(total, max(0, int((time.time() - o.start_time) * o.speed * per_sec)))}

    def partitions(self, start: dict, end: dict) -> Sequence[Share]:
        out = []
        for path, size, cap in self._captures():
            period = cap.chunks + self._quiet(cap)
            lo, hi = start["chunks"], min(end["chunks"], self._length(cap))
            for loop in range(lo // period, -(-hi // period)):
                a, b = max(lo - loop * period, 0), min(hi - loop * period, period)
                each = cap.n * cap.frame_bytes
                out += self.options.shares(path, size, a, min(b, cap.chunks), each, loop=loop)
                out += self.options.shares(path, size, max(a, cap.chunks), b, each, loop=loop, silence=True)
        return out

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        cap = self.options.capture(share.path, share.size)
        yield from _batches(self._played(cap, share), _arrow(S.CHUNKS + _REPLAY))

    def _played(self, cap: SimpleNamespace, share: Share) -> Iterator[tuple]:
        period, shift = cap.chunks + self._quiet(cap), share.loop * (cap.total_samples + self.gap)

        def place(k: int, start: int, end: int) -> tuple:
            ns = int(round((start + shift) / cap.sample_rate_hz * 1e9))
            again = share.loop > 0 and self.gap > 0 and k == 0
            return (
                cap.path, self.options.channel_id, share.loop * period + k, start + shift, end + shift, ns,
                cap.center_frequency_hz, cap.sample_rate_hz, cap.total_samples, again, 0,
            )

        if share.silence:
            for k in range(share.first, share.last):
                start = cap.total_samples + (k - cap.chunks) * cap.n
                end = min(start + cap.n, cap.total_samples + self.gap)
                zeros = np.zeros(end - start, "float32")
                yield (*place(k, start, end), zeros, zeros, share.loop + 1, True, None)
            return
        with S._open(share.path) as f:
            for r in _planned(cap, share.first, share.last):
                row = S.read_chunk(f, r, self.options.scale, self.options.channel_id)
                yield (*place(r.sequence_number, row[3], row[4]), row[11], row[12], share.loop + 1, False, row[3])


class RecordingSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "radio_iq"

    def schema(self) -> str:
        return S.CHUNKS + (_REPLAY if _Options(self.options).replay else "")

    def reader(self, schema) -> RecordingReader:
        options = _Options(self.options)
        if options.replay:
            raise ValueError("a replay is a stream; use replay_timeline on a table of chunks")
        return RecordingReader(options)

    def streamReader(self, schema) -> D.DataSourceStreamReader:
        options = _Options(self.options)
        return ReplayReader(options) if options.replay else RollingReader(options)


def register(spark: SparkSession, push_filters: bool = True) -> None:
    """Make the format known to a session."""
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
