"""Benchmark decontamination by a positional inverted index of the training texts.

``build_index`` stores, for slabs of a few MB of text (shards), one posting list per word: the
sorted positions of the word in its shard.  Documents of a shard lie one after the other in
position space with a gap between them.  ``phrase_matches`` takes the test texts in blocks of
bounded size, fetches only the lists of the block's words, and intersects them shard by shard:
for each window it starts with the window's rarest word in the shard, subtracts the word's
offset, and keeps the starts that the next rarer word's list holds too.  ``proximity_matches``
works on the same lists but lets the words of a window stand in any order within a span.

Shards have equal sizes whatever the keys of the documents are, so no word, source or group of
copies makes one task large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.words import slabs, split_words
from radiolake.session import persist_table

GAP = 256  # empty positions between two documents of a shard; spans must be shorter
INDEX = "shard bigint, term string, positions binary, slot int, doc_id bigint, th bigint, n_words int, base int"
_ARROW = pa.schema(
    [
        ("shard", pa.int64()),
        ("term", pa.string()),
        ("positions", pa.binary()),
        ("slot", pa.int32()),
        ("doc_id", pa.int64()),
        ("th", pa.int64()),
        ("n_words", pa.int32()),
        ("base", pa.int32()),
    ]
)


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _ARROW], schema=_ARROW)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists and a directory row per document, for slabs of the task's input."""
    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi in slabs(batch.column("text"), 2 << 20):
            ids, texts = batch.column("doc_id").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo)
            words, counts = split_words(texts)
            base = np.cumsum(counts + GAP) - counts - GAP
            yield _batch(
                hi - lo,
                shard=pa.array(np.full(hi - lo, shard)),
                slot=pa.array(np.arange(hi - lo, dtype=np.int32)),
                doc_id=ids,
                th=batch.column("th").slice(lo, hi - lo),
                n_words=pa.array(counts.astype(np.int32)),
                base=pa.array(base.astype(np.int32)),
            )
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            at = np.arange(len(codes)) + np.repeat(np.arange(len(counts)) * GAP, counts)
            order = np.argsort(codes, kind="stable")
            lists = at[order].astype(np.int32)
            ends = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]
            n = len(coded.dictionary)
            step = 20_000  # rows of one Arrow batch
            for k in range(0, n, step):
                m = min(n, k + step)
                yield _batch(
                    m - k,
                    shard=pa.array(np.full(m - k, shard)),
                    term=coded.dictionary.slice(k, m - k),
                    positions=pa.Array.from_buffers(
                        pa.binary(),
                        m - k,
                        [
                            None,
                            pa.py_buffer(((ends[k : m + 1] - ends[k]) * 4).astype(np.int32).tobytes()),
                            pa.py_buffer(lists[ends[k] : ends[m]].tobytes()),
                        ],
                    ),
                )
            shard += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional index of every word of every text, written to the shared folder.

    Rows with a term are posting lists (little-endian int32 positions); rows without one are
    the directory: a row for each input row, in which ids may be null or repeat.  A null or
    empty text has no postings but a directory row.  Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )
    return persist_table(rows.mapInArrow(_postings, INDEX), "postings")


def _word_lists():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = split_words(batch.column("text"))
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.ListArray.from_arrays(offsets, words)], names=["item_id", "words"]
            )

    return run


def _windows(lists: list[list[str]], size: int) -> tuple[list[str], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Vocabulary, distinct windows as rows of term numbers (-1 pads), their lengths, and the
    items that hold each window."""
    vocabulary = sorted({w for words in lists for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    holders: dict[tuple[int, ...], set[int]] = {}
    for item, words in enumerate(lists):
        codes = [number[w] for w in words]
        for k in range(max(1, len(codes) - size + 1) if codes else 0):
            holders.setdefault(tuple(codes[k : k + size]), set()).add(item)
    grid = np.full((len(holders), size), -1, dtype=np.int64)
    for row, window in enumerate(holders):
        grid[row, : len(window)] = window
    return vocabulary, grid, (grid >= 0).sum(axis=1), [np.array(sorted(x)) for x in holders.values()]


class _Shard:
    """The lists of one shard that a block needs, as one sorted array of (term, position) keys."""

    def __init__(self, rows: pa.Table, vocabulary: list[str]):
        listed = rows.filter(pc.is_valid(rows.column("term")))
        term = pc.index_in(listed.column("term").combine_chunks(), pa.array(vocabulary, pa.string()))
        term = term.to_numpy(zero_copy_only=False).astype(np.int64)
        blobs = [np.frombuffer(x, dtype=np.int32) for x in listed.column("positions").to_pylist()]
        size = np.array([len(x) for x in blobs], dtype=np.int64)
        self.counts = np.zeros(len(vocabulary) + 1, dtype=np.int64)  # the last one stands for padding
        self.counts[term] = size
        keys = np.repeat(term << 32, size) + (np.concatenate(blobs) if blobs else np.zeros(0, dtype=np.int32))
        self.keys = np.sort(keys)
        self.first = np.r_[0, np.cumsum(self.counts[:-1])]
        docs = rows.filter(pc.is_null(rows.column("term"))).sort_by("slot")
        self.slot = docs.column("slot").to_numpy()
        self.base = docs.column("base").to_numpy().astype(np.int64)
        self.doc_id = docs.column("doc_id").combine_chunks()

    def positions(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every position of each term: row numbers into ``terms``, positions."""
        n = self.counts[terms]
        row = np.repeat(np.arange(len(terms)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, self.keys[self.first[terms][row] + within] & 0xFFFFFFFF

    def holds(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys = (terms << 32) + at
        found = np.searchsorted(self.keys, keys)
        return self.keys[np.minimum(found, len(self.keys) - 1)] == keys

    def following(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First position of the term at or after ``at``, or a very large number."""
        found = np.searchsorted(self.keys, (terms << 32) + at)
        key = self.keys[np.minimum(found, len(self.keys) - 1)]
        return np.where((found < len(self.keys)) & (key >> 32 == terms), key & 0xFFFFFFFF, 1 << 40)

    def rarest_first(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose words all occur in the shard, and for each its offsets by rising count."""
        counts = np.where(grid >= 0, self.counts[grid], 1 << 40)
        alive = np.flatnonzero((counts > 0).all(axis=1))
        return alive, np.argsort(counts[alive], axis=1, kind="stable")


def _phrases(shard: _Shard, grid: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence."""
    alive, order = shard.rarest_first(grid)
    rows, at = shard.positions(grid[alive, order[:, 0]])
    start = at - order[rows, 0]
    for rank in range(1, grid.shape[1]):
        offset = order[rows, rank]
        term = grid[alive[rows], offset]
        keep = (start >= 0) & ((term < 0) | shard.holds(term, start + offset))
        rows, start = rows[keep], start[keep]
    keep = start >= 0
    return alive[rows[keep]], start[keep]


def _near(shard: _Shard, grid: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of the stretches of at most ``span`` words, starting with a word of the
    window, that hold all its words in any order."""
    alive, order = shard.rarest_first(grid)
    rows, at = shard.positions(grid[alive, order[:, 0]])
    rows, start = np.repeat(rows, span), (at[:, None] - np.arange(span)[None, :]).ravel()
    rows, start = rows[start >= 0], start[start >= 0]
    begins = np.zeros(len(rows), dtype=bool)
    for rank in range(grid.shape[1]):
        term = grid[alive[rows], order[rows, rank]]
        after = np.where(term < 0, start + 1, shard.following(np.maximum(term, 0), start))
        begins |= (term >= 0) & (after == start)
        keep = after < start + span
        rows, start, begins = rows[keep], start[keep], begins[keep]
    found = np.unique(np.stack([alive[rows], start], axis=1)[begins], axis=0)
    return found[:, 0], found[:, 1]


_MATCH = "shard bigint, slot int, doc_id bigint, item_id string, start int, length int"
_MATCH_ARROW = pa.schema(
    [
        ("shard", pa.int64()),
        ("slot", pa.int32()),
        ("doc_id", pa.int64()),
        ("item_id", pa.string()),
        ("start", pa.int32()),
        ("length", pa.int32()),
    ]
)


def _search(block, span: int | None):
    def run(rows: pa.Table) -> pa.Table:
        items, vocabulary, grid, lengths, holders = block.value
        shard = _Shard(rows, vocabulary)
        if not len(shard.keys) or not len(shard.base):
            return _MATCH_ARROW.empty_table()
        window, start = _phrases(shard, grid, lengths) if span is None else _near(shard, grid, lengths, span)
        if not len(window):
            return _MATCH_ARROW.empty_table()
        n = np.array([len(holders[w]) for w in window])
        item = np.concatenate([holders[w] for w in window])
        start = np.repeat(start, n)
        length = np.repeat(lengths[window] if span is None else np.full(len(window), span), n)
        slot = np.searchsorted(shard.base, start, side="right") - 1
        order = np.lexsort((start, item, slot))
        slot, item, start, length = slot[order], item[order], start[order], length[order]
        # one row for each stretch that windows of the item cover without a break
        fresh = np.ones(len(slot), dtype=bool)
        fresh[1:] = (slot[1:] != slot[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + length[:-1])
        head = np.flatnonzero(fresh)
        tail = np.r_[head[1:], len(slot)] - 1
        return pa.table(
            [
                pa.array(np.full(len(head), rows.column("shard")[0].as_py())),
                pa.array(shard.slot[slot[head]]),
                shard.doc_id.take(pa.array(slot[head])),
                pa.array(items, pa.string()).take(pa.array(item[head])),
                pa.array((start[head] - shard.base[slot[head]]).astype(np.int32)),
                pa.array((start[tail] + length[tail] - start[head]).astype(np.int32)),
            ],
            schema=_MATCH_ARROW,
        )

    return run


def _matches(
    index: DataFrame, tests: DataFrame, size: int, span: int | None, id_col: str, text_col: str, block_words: int
) -> DataFrame:
    spark = index.sparkSession
    lists = tests.select(
        F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(_word_lists(), "item_id string, words array<string>")
    lists = persist_table(lists.where(F.size("words") > 0), "test-words")
    total = lists.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    block_of = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    out = spark.createDataFrame([], _MATCH)
    for k in range(blocks):
        rows = lists.where(block_of == k).collect()  # about block_words words
        if not rows:
            continue
        vocabulary, grid, lengths, holders = _windows([r.words for r in rows], size)
        block = spark.sparkContext.broadcast(([r.item_id for r in rows], vocabulary, grid, lengths, holders))
        terms = spark.createDataFrame([(t,) for t in vocabulary], "term string")
        wanted = index.join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "positions", "slot", "doc_id", "base")
        wanted = wanted.unionByName(
            index.where(F.col("term").isNull()).select("shard", "term", "positions", "slot", "doc_id", "base")
        )
        out = out.unionByName(wanted.groupBy("shard").applyInArrow(_search(block, span), _MATCH))
    return out


def phrase_matches(
    index: DataFrame,
    tests: DataFrame,
    size: int = 10,
    id_col: str = "item_id",
    text_col: str = "text",
    block_words: int = 200_000,
) -> DataFrame:
    """Stretches of training texts that windows of ``size`` consecutive test words cover.

    A row (shard, slot, doc_id, item_id, start, length) for each unbroken stretch of each test
    text; start counts words of the document from 0.  A test text with fewer than ``size``
    words is one window; one without words matches nothing.  Repeated test texts all match.
    The tests are handled in blocks of about ``block_words`` words, the bound on what is
    broadcast; more tests mean more passes over the index, never fewer results.
    """
    return _matches(index, tests, size, None, id_col, text_col, block_words)


def proximity_matches(
    index: DataFrame,
    tests: DataFrame,
    size: int = 10,
    span: int = 16,
    id_col: str = "item_id",
    text_col: str = "text",
    block_words: int = 200_000,
) -> DataFrame:
    """Like ``phrase_matches`` where the words of a window may stand in any order within
    ``span`` words (at most GAP).  A word that a window holds twice has to occur once."""
    if not 1 <= span <= GAP:
        raise ValueError(f"span must be from 1 to {GAP}")
    return _matches(index, tests, size, span, id_col, text_col, block_words)


def directory(index: DataFrame) -> DataFrame:
    """(shard, slot, doc_id, th, n_words), a row for each row that was indexed; th is the hash of
    its text."""
    return index.where(F.col("term").isNull()).select("shard", "slot", "doc_id", "th", "n_words")


def contamination(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per indexed row: doc_id, th, n_words, n_hit (words inside any match), item_ids (sorted strings)."""
    found = persist_table(matches, "matches")
    places = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")
    hits = found.select("shard", "slot", places).distinct().groupBy("shard", "slot").agg(F.count("*").alias("n_hit"))
    items = found.groupBy("shard", "slot").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return (
        directory(index)
        .join(hits, ["shard", "slot"], "left")
        .join(items, ["shard", "slot"], "left")
        .select(
            "doc_id",
            "th",
            F.col("n_words").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )
