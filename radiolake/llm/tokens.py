"""Token ids of a corpus in a binary format of checksummed, independently coded blocks.

``write_tokens`` range-partitions the texts by id, encodes them, and writes one row per block to
Parquet files, so that Spark's commit protocol covers lost executors and any store will do.  A
block (see ``rangecoder``) holds the ids of whole documents, one to three million ids, and a table of
their doc_ids and lengths.  ``read_tokens`` decodes blocks independently of each other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.chunks import ChunkTable, split_at, sums_by
from radiolake.llm.rangecoder import pack_block, unpack_block
from radiolake.llm.words import slabs

_MARK = "\x7f"  # stands between chunks that are encoded together


def _breaks() -> np.ndarray:
    """Pairs of ASCII bytes between which the tokenizer always cuts: letters and other marks, and
    around digits; the apostrophe, which may belong to letters, is left alone."""
    code = np.arange(256)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
    digit = (code >= 48) & (code <= 57)
    mark = (code > 32) & (code < 127) & ~letter & ~digit & (code != 39)
    both = letter | digit | mark
    breaks = (letter[:, None] & mark) | (mark[:, None] & letter) | (digit[:, None] & both) | (both[:, None] & digit)
    return breaks


_BREAKS, _NO_BREAKS = _breaks(), np.zeros((256, 256), dtype=bool)


class WordEncoder:
    """Ids of chunks without spaces or line feeds by a tokenizers file, many chunks in a call.

    Holds for tokenizers that ignore case, drop spaces and line feeds, and take letters, single
    digits and runs of other marks apart before they merge; the ids of a text are then those of
    its chunks.
    """

    def __init__(self, path: str, together: int = 500):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.together = together
        (self.mark,) = self._ids([_MARK])[0]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the chunks, and their number by chunk."""
        together = self.together
        if any(_MARK in c for c in chunks):
            alone = [np.array(ids, dtype=np.int32) for ids in self._ids(list(chunks))]
            return np.concatenate(alone), np.array([len(a) for a in alone], dtype=np.int64)
        joined = [f" {_MARK} ".join([*chunks[k : k + together], ""]) for k in range(0, len(chunks), together)]
        ids = np.concatenate([np.array(x, dtype=np.int32) for x in self._ids(joined)])
        marks = np.flatnonzero(ids == self.mark)  # one behind each chunk
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1


_ENCODERS: dict[str, tuple[WordEncoder, ChunkTable]] = {}  # one per worker and file


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Flat ids of a batch, ids by text, size of the vocabulary; a null text is empty."""
    if path not in _ENCODERS:
        encoder = WordEncoder(path)
        _ENCODERS[path] = (encoder, ChunkTable(encoder.encode))
    encoder, table = _ENCODERS[path]
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, "<|")).as_py():  # the names of special tokens stay whole
        chunks, counts = split_at(texts, _NO_BREAKS, b" \n")
    else:
        chunks, counts = split_at(pc.ascii_lower(texts), _BREAKS, b" \n")
    ids, sizes = table.flat_ids(chunks)
    return ids, sums_by(sizes, counts), encoder.vocabulary


_BLOCKS = "part int, seq int, n_docs int, first bigint, n_tokens bigint, block binary"


def _rows_table(ids: pa.Array, lengths: np.ndarray) -> bytes:
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    return (
        pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        + lengths.astype("<u4").tobytes()
        + nulls.astype("u1").tobytes()
    )


def _write_blocks(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = first = vocabulary = 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, first, seq
            doc_ids = pa.concat_arrays([h[0] for h in held])
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            packed = pack_block(ids, _rows_table(doc_ids, lengths), len(lengths), vocabulary)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([len(lengths)], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([packed], pa.binary()),
                ],
                names=["part", "seq", "n_docs", "first", "n_tokens", "block"],
            )
            held, size, first, seq = [], 0, first + len(ids), seq + 1
            return out

        for batch in batches:
            for lo, hi in slabs(batch.column("text"), 4 << 20):
                ids, counts, vocabulary = encode_texts(batch.column("text").slice(lo, hi - lo), path)
                vocabulary = max(vocabulary, end_id + 1)
                lengths = counts + 1
                full = np.empty(int(lengths.sum()), dtype=np.int32)
                ends = np.cumsum(lengths) - 1
                body = np.ones(len(full), dtype=bool)
                body[ends] = False
                full[body], full[ends] = ids, end_id
                held.append((batch.column("doc_id").slice(lo, hi - lo), full, lengths))
                size += len(full)
                if size >= block_tokens:
                    yield block()
        if held:
            yield block()

    return run


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    block_tokens: int = 1_500_000,
) -> None:
    """Write the ids of every text, with ``end_id`` appended, in ascending order of id.

    Null ids come first; rows with equal ids follow each other, ordered by the hash of their text.  A null
    or empty text has only the end id.  Other columns are not read.  A block ends after the
    slab of whole documents (4 MB of text) that fills it.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_write_blocks(tokenizer, end_id, block_tokens), _BLOCKS).write.parquet(out)


_DOCS = "part int, doc_id bigint, before bigint, n_tokens bigint, ids binary"


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, block in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "block")), strict=True):
            ids, rows, n = unpack_block(block)
            doc_ids = np.frombuffer(rows, dtype="<i8", count=n)
            lengths = np.frombuffer(rows, dtype="<u4", count=n, offset=8 * n).astype(np.int64)
            nulls = np.frombuffer(rows, dtype="u1", count=n, offset=12 * n).astype(bool)
            before = np.cumsum(lengths) - lengths
            step = 5_000
            for k in range(0, n, step):
                m = min(n, k + step) - k
                lo, hi = before[k], before[k + m - 1] + lengths[k + m - 1]
                bounds = np.r_[before[k : k + m] - lo, hi - lo] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, part, dtype=np.int32)),
                        pa.array(doc_ids[k : k + m], mask=nulls[k : k + m]),
                        pa.array(first + before[k : k + m]),
                        pa.array(lengths[k : k + m]),
                        pa.Array.from_buffers(
                            pa.binary(),
                            m,
                            [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(ids[lo:hi].astype("<u4").tobytes())],
                        ),
                    ],
                    names=["part", "doc_id", "before", "n_tokens", "ids"],
                )


def part_starts(blocks: DataFrame) -> DataFrame:
    """(part, base): the ids before each written partition; a row per partition."""
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit
    integers, start the number of ids of all documents before.  Raises CorruptBlock where a
    checksum does not fit.  Broadcasts one number for each partition that was written."""
    blocks = spark.read.parquet(path)
    docs = blocks.select("part", "first", "block").mapInArrow(_read_blocks, _DOCS)
    return docs.join(F.broadcast(part_starts(blocks)), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids"
    )
