"""Divergence of sources by term frequencies, by chunk factorisation.

Texts are cut at white space.  Chunks are counted per document and summed by (language, source,
chunk); each distinct chunk of the whole table is tokenised once, and its terms are joined back to
the counts.  Occurrences of a term are sums over its chunks.  So are its documents, but for those
that hold the term in several chunks: the largest count of one chunk is a lower bound and the sum an upper one.
Where the threshold lies between them the documents are read again for the chunks of those terms
alone, and distinct documents are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.chunks import split_at
from radiolake.llm.words import slabs
from radiolake.session import persist_table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NO_BREAKS = np.zeros((256, 256), dtype=bool)
SCALE = 1_000_000_000


def _document_chunks(batch: pa.RecordBatch) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct chunks of a batch, and for every (document, chunk) of it the row, the chunk's
    number and its occurrences."""
    texts = pc.ascii_lower(batch.column("text"))
    split = [split_at(texts.slice(lo, hi - lo), _NO_BREAKS, drop=_SPACE) for lo, hi in slabs(texts, 1 << 20)]
    if not split:
        return pa.array([], pa.string()), *(np.zeros(0, dtype=np.int64) for _ in range(3))
    coded = pa.chunked_array([chunks for chunks, _ in split]).combine_chunks().dictionary_encode()
    counts = np.concatenate([counts for _, counts in split])
    size = max(1, len(coded.dictionary))
    pair = np.repeat(np.arange(len(counts)) * size, counts)
    pair += coded.indices.to_numpy()
    pair.sort()
    at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.r_[at, len(pair)])
    pair = pair[at]
    return coded.dictionary, pair // size, pair % size, n


def _gathered(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to about ``max_bytes`` of text; a text is never cut."""
    held, size = [], 0
    for batch in batches:
        for lo, hi in slabs(batch.column("text"), max_bytes):
            part = batch.slice(lo, hi - lo)
            own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + own > max_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_COUNTS = "lang string, source string, chunk string, n_docs bigint, n bigint"


def _count_chunks(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, max_bytes):
            names, row, code, n = _document_chunks(batch)
            if not len(row):
                continue
            lang = batch.column("lang").dictionary_encode()
            source = batch.column("source").dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key = group[row] * len(names) + code
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            group, code = key[at] // len(names), key[at] % len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(group // len(source.dictionary))),
                    source.dictionary.take(pa.array(group % len(source.dictionary))),
                    names.take(pa.array(code)),
                    pa.array(np.diff(np.r_[at, len(key)])),
                    pa.array(np.add.reduceat(n, at)),
                ],
                names=["lang", "source", "chunk", "n_docs", "n"],
            )

    return run


def _document_rows(bits: np.ndarray, max_bytes: int):
    """(lang, chunk, document number) of the chunks whose hash is set in ``bits``."""
    slots = np.uint64(len(bits) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in _gathered(batches, max_bytes):
            names, row, code, _ = _document_chunks(batch)
            hashed = np.array([xxhash.xxh64_intdigest(c, seed=42) for c in names.to_pylist()], dtype=np.uint64) % slots
            wanted = (bits[hashed >> np.uint64(3)] >> (hashed & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            keep = wanted[code]
            row, code = row[keep], code[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array(row)), names.take(pa.array(code)), pa.array(row + number)],
                names=["lang", "chunk", "document"],
            )
            number += batch.num_rows

    return run


def _bitmap(hashes: DataFrame, slots: int) -> np.ndarray:
    """Low bits of ``hashes`` as a set of ``slots`` bits, a power of two; the driver gets slots / 8 bytes at most."""
    slot = F.col(hashes.columns[0]).bitwiseAND(F.lit(slots - 1).cast("bigint"))
    marks = hashes.select(slot.alias("slot")).selectExpr("slot DIV 8 AS at", "shiftleft(1, CAST(slot % 8 AS INT)) AS mark")
    found = marks.groupBy("at").agg(F.bit_or("mark").alias("byte")).toArrow()
    bits = np.zeros(slots // 8, dtype=np.uint8)
    bits[found.column("at").to_numpy()] = found.column("byte").to_numpy().astype(np.uint8)
    return bits


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(
    docs: DataFrame, min_docs: int = 10, slab_bytes: int = 24 << 20, filter_bits: int = 1 << 26
) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms that at least ``min_docs`` documents
    of their language hold.

    A document is a row, whatever its id; a null text, lang or source is the empty string.  Terms are
    maximal runs outside ASCII or of ASCII letters, A-Z in lower case.  ``slab_bytes`` bounds
    the text that a task counts at a time (but for a single longer text), ``filter_bits`` the
    set by which the second reading knows its chunks; both change no result.
    """
    texts = _read(docs)
    counts = persist_table(
        texts.mapInArrow(_count_chunks(slab_bytes), _COUNTS)
        .groupBy("lang", "source", "chunk")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")),
        "chunk-counts",
    )
    tokenised = (
        counts.select(F.col("chunk").alias("of"))
        .distinct()
        .select("of", F.explode(F.regexp_extract_all("of", F.lit(TERM), F.lit(0))).alias("term"))
        .groupBy("of", "term")
        .agg(F.count("*").alias("times"))
    )
    tokenised = persist_table(tokenised, "chunk-terms")
    by_source = persist_table(
        counts.join(tokenised, F.col("chunk") == F.col("of"))
        .groupBy("lang", "source", "term")
        .agg(
            F.sum(F.col("n") * F.col("times")).alias("n"),
            F.max("n_docs").alias("low"),
            F.sum("n_docs").alias("high"),
        ),
        "term-counts",
    )
    bounds = by_source.groupBy("lang", "term").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    bounds = persist_table(bounds.where(F.col("high") >= min_docs), "term-bounds")
    sure = bounds.where(F.col("low") >= min_docs).select("lang", "term")
    open_terms = bounds.where(F.col("low") < min_docs).select("lang", F.col("term").alias("open"))
    open_chunks = persist_table(
        open_terms.join(tokenised, F.col("open") == F.col("term")).select(
            F.col("lang").alias("of_lang"), "of", "term"
        ),
        "open-chunks",
    )
    bits = _bitmap(open_chunks.select(F.xxhash64("of")), filter_bits)
    kept = sure
    if bits.any():
        again = texts.mapInArrow(
            _document_rows(bits, slab_bytes), "lang string, chunk string, document bigint"
        )
        counted = (
            again.join(open_chunks, (F.col("lang") == F.col("of_lang")) & (F.col("chunk") == F.col("of")))
            .select("lang", "term", "document")
            .distinct()
            .groupBy("lang", "term")
            .agg(F.count("*").alias("n_docs"))
        )
        kept = kept.union(counted.where(F.col("n_docs") >= min_docs).select("lang", "term"))
    kept = kept.select(F.col("lang").alias("k_lang"), F.col("term").alias("k_term"))
    return by_source.join(kept, (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term"))).select(
        "lang", "source", "term", "n"
    )


def _share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in whole numbers of up to 38 digits."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(12, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) DIV ({total} + 2 * {terms}) AS BIGINT)")


def _gap(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


_SHARED = pa.schema(
    [("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("shared", pa.int64()), ("extra", pa.int64())]
)


def _shared(rows: pa.Table) -> pa.Table:
    """For each pair of sources, both ways round: the terms of this part of the vocabulary that both have,
    and what these add over a term that one of them lacks, lacking in either way."""
    source = rows.column("source").combine_chunks().dictionary_encode()
    term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    names, at = source.dictionary.to_pylist(), source.indices.to_numpy()
    p = np.zeros((len(names), int(term.max()) + 1), dtype=np.int64)
    p[at, term] = rows.column("p").to_numpy()
    base = np.zeros(len(names), dtype=np.int64)
    base[at] = rows.column("p0").to_numpy()

    def gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x - y) * (x - y) // np.maximum(x + y, 1)

    a, b, shared, extra = [], [], [], []
    for i in range(len(names)):
        mine = p[i] > 0
        x, y = p[i, mine][None, :], p[:, mine]
        both = y > 0
        more = np.where(both, gap(x, y) - gap(x, base[:, None]) - gap(base[i], y), 0).sum(axis=1)
        for j in np.flatnonzero(both.any(axis=1)).tolist():
            if j != i:
                a.append(names[i])
                b.append(names[j])
                shared.append(int(both[j].sum()))
                extra.append(int(more[j]))
    lang = rows.column("lang")[0].as_py()
    return pa.table([[lang] * len(a), a, b, shared, extra], schema=_SHARED)


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, block_cells: int = 2_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each language differ.

    Part ``pair`` compares a source with each other one of its language, summed over the kept
    terms of the language; part ``term`` lists the ``top`` kept terms that the source uses more than the
    language does.  Shares and gaps are whole numbers (``_share``, ``_gap``).  A term that neither of two sources
    has adds a gap that depends on their totals alone, one that only one of them has depends
    on its own share, so pairs meet per term only where both have it: in blocks of the
    vocabulary of about ``block_cells`` (source, term) cells, which give one row for each pair.
    """
    groups = persist_table(_read(docs).select("lang", "source").distinct(), "groups")
    counts = persist_table(term_counts(docs, min_docs), "kept-terms")
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    in_lang = persist_table(in_lang, "lang-terms")
    lang_sizes = in_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    n_groups = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    stats = (
        groups.join(sizes, ["lang", "source"], "left")
        .join(n_groups, "lang")
        .join(lang_sizes, "lang", "left")
        .select("lang", "source", "sources", zero("total"), zero("own"), zero("terms"), zero("lang_total"))
        .withColumn("p0", F.when(F.col("terms") > 0, _share("0", "total", "terms")))
    )
    stats = persist_table(stats, "groups-sized")
    blocks = F.ceil(F.col("terms") * F.col("sources") / F.lit(block_cells))
    shares = (
        counts.join(stats, ["lang", "source"])
        .withColumn("p", _share("n", "total", "terms"))
        .withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    )
    shares = persist_table(
        shares.select("lang", "source", "term", "n", "p", "p0", "terms", "lang_total", "block"), "shares"
    )
    shared = (
        shares.select("lang", "block", "source", "term", "p", "p0")
        .groupBy("lang", "block")
        .applyInArrow(_shared, "lang string, a string, b string, shared bigint, extra bigint")
        .groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item"))
        .agg(F.sum("shared").alias("shared"), F.sum("extra").alias("extra"))
    )
    others = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("its_own"))
    pairs = persist_table(
        stats.select("lang", "source", "p0", "own", "terms")
        .join(others, "lang")
        .where("source <> item")
        .join(shared, ["lang", "source", "item"], "left"),
        "pairs",
    )
    # gaps of the terms of one source against another's share of a missing term, by distinct share
    distinct = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = (
        distinct.join(others.where("q0 IS NOT NULL"), "lang")
        .where("source <> item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.col("times") * _gap("p", "q0")).alias("alone"))
    )
    alone = persist_table(alone, "one-sided")
    back = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("its_alone"))
    zero_of = lambda c: F.coalesce(F.col(c), F.lit(0))
    neither = F.col("terms") - F.col("own") - F.col("its_own") + zero_of("shared")
    value = zero_of("extra") + zero_of("alone") + zero_of("its_alone") + neither * _gap("p0", "q0")
    by_pair = (
        pairs.join(alone, ["lang", "source", "item"], "left")
        .join(back, ["lang", "source", "item"], "left")
        .select(
            "lang", "source", F.lit("pair").alias("part"), "item",
            F.when(F.col("terms") > 0, value).otherwise(0).cast("bigint").alias("value"),
        )
    )
    by_term = (
        shares.join(in_lang, ["lang", "term"])
        .withColumn("q", _share("lang_n", "lang_total", "terms"))
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    )
    order = "row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)"
    ranked = lambda df: df.withColumn("rank", F.expr(order))
    return ranked(by_pair).unionByName(ranked(by_term).where(F.col("rank") <= top))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
          FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n,
        1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
      FROM dense JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
      FROM l JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 10
"""
