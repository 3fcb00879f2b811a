"""Removal of passages that repeat across documents, by runs of consecutive sentences.

A run is the shortest stretch of at least ``min_sentences`` sentences that reaches ``min_words``
words, taken from every sentence forwards and from every sentence backwards; one sentence of
``long_sentence`` words is a run of its own.  Whatever passage of whole sentences repeats, each
of its sentences then lies in a run inside the passage, if it has as many words and sentences
as a run needs.  Runs are hashed (128 bits), joined globally on the hash, and every sentence
that a non-first occurrence covers is removed.  First is the smallest (doc_id, text hash,
sentence number); null ids come first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.llm.words import slabs
from radiolake.session import persist_table

# a sentence ends at a stop followed by white space, or with its line; a run of white space is
# looked at from its start alone, so long ones take linear time
_BREAK = re.compile(r"(\s(?:(?<=[.!?…。！？]\s)\s*|(?<!\s\s)(?:(?<=\n)|\s*\n)\s*))")

_RUNS = "h binary, doc_id bigint, th bigint, start int, n int"
_RUNS_ARROW = pa.schema(
    [("h", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
)


def split_sentences(text: str) -> tuple[list[str], list[str]]:
    """Sentences, and the white space after each."""
    parts = _BREAK.split(text)
    return parts[::2], [*parts[1::2], ""]


def sentence_runs(counts: list[int], min_words: int, min_sentences: int, long_sentence: int) -> set[tuple[int, int]]:
    """(first, last + 1) of every run, for the numbers of words of the sentences."""
    runs, n = set(), len(counts)
    end = words = 0
    for start in range(n):  # the shortest run from each sentence forwards
        while end < n and (words < min_words or end - start < min_sentences):
            words += counts[end]
            end += 1
        if words < min_words or end - start < min_sentences:
            break
        runs.add((start, end))
        words -= counts[start]
    start, words = n, 0
    for end in range(n, 0, -1):  # and backwards
        while start > 0 and (words < min_words or end - start < min_sentences):
            start -= 1
            words += counts[start]
        if words < min_words or end - start < min_sentences:
            break
        runs.add((start, end))
        words -= counts[end - 1]
    runs.update((i, i + 1) for i, c in enumerate(counts) if c >= long_sentence)
    return runs


def _hash_runs(min_words: int, min_sentences: int, long_sentence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slabs(whole.column("text"), 1 << 20):
                batch = whole.slice(lo, hi - lo)
                h, ids, ths, starts, ns = [], [], [], [], []
                for doc_id, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                    sentences = [s.lower().split() for s in split_sentences(text or "")[0]]
                    plain = [" ".join(s) for s in sentences]
                    found = sentence_runs([len(s) for s in sentences], min_words, min_sentences, long_sentence)
                    for a, b in found:
                        h.append(xxhash.xxh3_128_digest("\n".join(plain[a:b])))
                        starts.append(a)
                        ns.append(b - a)
                    ids += [doc_id] * len(found)
                    ths += [th] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip((h, ids, ths, starts, ns), _RUNS_ARROW.types, strict=True)],
                    schema=_RUNS_ARROW,
                )

    return run


def repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 20,
    min_sentences: int = 2,
    long_sentence: int = 40,
) -> DataFrame:
    """(doc_id, th, start, n) of every run that occurs earlier too, here or in another document."""
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )
    runs = texts.mapInArrow(_hash_runs(min_words, min_sentences, long_sentence), _RUNS)
    at = F.struct("doc_id", "th", "start")
    # a hot run sends one row per task; the runs that repeat are written, so that both sides of
    # the join back have exchanges of their own, which lets AQE split hot runs
    first = runs.groupBy("h").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last")
    first = persist_table(first.select("h", "first"), "repeated-runs")
    return runs.join(first, "h").where(~at.eqNullSafe(F.col("first"))).select("doc_id", "th", "start", "n")




def without(text: str, covered: set[int]) -> tuple[str, int, list[str]]:
    """The text without the covered sentences, their number, and the removed stretches."""
    sentences, spaces = split_sentences(text)
    kept: list[str] = []
    removed: list[str] = []
    gap, last = "", -2
    for i, (sentence, space) in enumerate(zip(sentences, spaces, strict=True)):
        if i in covered:
            if last == i - 1:
                removed[-1] += spaces[i - 1] + sentence
            else:
                removed.append(sentence)
            last = i
            gap = gap if "\n" in gap or not space else space
            continue
        if kept:
            kept.append(gap)
        kept.append(sentence)
        gap = space
    return "".join(kept), sum(i in covered for i in range(len(sentences))), removed


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 20,
    min_sentences: int = 2,
    long_sentence: int = 40,
) -> DataFrame:
    """All columns of ``docs``, with ``text_col`` free of repeated runs, then n_sentences,
    n_removed and removed (the removed stretches).

    A null text stays null, an empty one empty; both have no sentences removed.  Rows that
    agree in id and text count as one document and get the same result.  Columns of ``docs``
    that have one of these three names are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed")]
    found = repeated_runs(docs, id_col, text_col, min_words, min_sentences, long_sentence)
    spans = found.groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"))
    spans = spans.agg(F.collect_list(F.struct("start", "n")).alias("__spans"))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__th"))
    joined = docs.select(*names).join(spans, same, "left").select(*names, "__spans")
    schema = docs.select(*names).schema
    schema = schema.add("n_sentences", "integer").add("n_removed", "integer").add("removed", T.ArrayType(T.StringType()))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slabs(whole.column(text_col), 1 << 20):
                batch = whole.slice(lo, hi - lo)
                texts, sizes, gone, parts = [], [], [], []
                for text, spans in zip(
                    batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist(), strict=True
                ):
                    covered = {i for s in spans or () for i in range(s["start"], s["start"] + s["n"])}
                    new, n, removed = without(text or "", covered) if covered else (text, 0, [])
                    texts.append(new)
                    sizes.append(len(split_sentences(text)[0]) if text else 0)
                    gone.append(n)
                    parts.append(removed)
                kind = batch.schema.field(text_col).type
                columns = [pa.array(texts, kind) if c == text_col else batch.column(c) for c in names]
                columns += [pa.array(sizes, pa.int32()), pa.array(gone, pa.int32()), pa.array(parts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_sentences", "n_removed", "removed"])

    return joined.mapInArrow(rebuild, schema)
