"""Similarity join on word shingles by a MinHash LSH forest with exact verification.

Texts with equal shingle sets form one class from the start, so copies never meet as pairs.
Each class has ``trees`` sorted prefixes of its MinHash signature.  Prefixes are matched at the
largest depth whose expected recall for a pair right at the threshold reaches ``recall``: the
depth starts at ``max_depth`` and is shortened until it does.  Classes that share a prefix in any
tree are linked by stars and fall into candidate components.  Each component is verified exactly:
its sets are cut into blocks of bounded size, every pair of blocks is one unit of work, and a
unit returns the number of links of each of its sets and a spanning forest of its links, never
the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.components import connected_by_leads
from radiolake.llm.words import slabs, split_words
from radiolake.session import persist_table

WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def expected_recall(depth: int, trees: int, similarity: float) -> float:
    """Chance that two sets of this similarity share a prefix of ``depth`` in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(trees: int, similarity: float, recall: float, max_depth: int) -> int:
    """Depth after shortening the prefix until the expected recall reaches the target."""
    depth = max_depth
    while depth > 1 and expected_recall(depth, trees, similarity) < recall:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, flat, and their number by text.

    A text of fewer than ``words`` words, but not none, has one shingle of all its words.
    """
    tokens, counts = split_words(texts, "unicode")
    if not len(tokens):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(counts), dtype=np.int64)
    coded = tokens.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    hashed = own[coded.indices.to_numpy()]
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(ends, counts) - np.arange(len(hashed))  # words from here to the end of the text
    first = np.repeat(ends - counts, counts) == np.arange(len(hashed))
    value = np.full(len(hashed), np.uint64(words))
    size = np.minimum(left, words)
    padded = np.r_[hashed, np.zeros(words, dtype=np.uint64)]
    for k in range(words):
        value = np.where(size > k, _mixed(value * _MIX + padded[k : k + len(hashed)]), value)
    keep = (left >= words) | first
    row, value = row[keep], value[keep]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.bincount(row[fresh], minlength=len(counts))


_SETS = "doc_id bigint, th bigint, key binary, n int, prefixes array<bigint>"
_SETS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("th", pa.int64()),
        ("key", pa.binary()),
        ("n", pa.int32()),
        ("prefixes", pa.list_(pa.int64())),
    ]
)


def _signatures(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(1)
        factor = rng.integers(0, 1 << 63, size=trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offset = rng.integers(0, 1 << 63, size=trees * depth, dtype=np.uint64)
        for batch in batches:
            for lo, hi in slabs(batch.column("text"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                values, counts = shingle_sets(part.column("text"))
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                prefixes = np.zeros((len(counts), trees), dtype=np.uint64)
                for tree in range(trees if len(full) else 0):
                    prefix = np.full(len(full), np.uint64(tree))
                    for k in range(tree * depth, (tree + 1) * depth):
                        low = np.minimum.reduceat((values * factor[k] + offset[k]) >> np.uint64(32), starts)
                        prefix = _mixed(prefix * _MIX + low)
                    prefixes[full, tree] = prefix
                bounds = np.r_[0, np.cumsum(counts)]
                keys = [xxhash.xxh3_128_digest(values[bounds[i] : bounds[i + 1]].tobytes()) for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("th"),
                        pa.array(keys, pa.binary()),
                        pa.array(counts.astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(counts) + 1, dtype=np.int32) * trees),
                            pa.array(prefixes.ravel().view(np.int64)),
                        ),
                    ],
                    schema=_SETS_ARROW,
                )

    return run


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its shingles (little-endian 64-bit integers)."""
    for batch in batches:
        for lo, hi in slabs(batch.column("text"), 2 << 20):
            part = batch.slice(lo, hi - lo)
            values, counts = shingle_sets(part.column("text"))
            bounds = np.r_[0, np.cumsum(counts)]
            blobs = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(blobs, pa.binary())], names=[*names, "shingles"]
            )


_UNIT = "key binary, other binary, n_texts bigint, n_docs bigint"
_UNIT_ARROW = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("n_texts", pa.int64()), ("n_docs", pa.int64())])


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of pairs of sets whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    values, columns = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    common = np.bincount(columns, minlength=len(values)) > 1
    number = np.cumsum(common) - 1
    keep = common[columns]
    rows, columns = rows[keep], number[columns[keep]]
    shared = np.zeros((len(sets), len(sets)), dtype=np.int64)
    width = max(1, (4 << 20) // len(sets))
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for lo in range(0, int(common.sum()), width):
        a, b = np.searchsorted(columns, [lo, lo + width])
        grid = np.zeros((len(sets), width), dtype=np.float32)
        grid[rows[a:b], columns[a:b] - lo] = 1
        shared += (grid @ grid.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    found = shared >= threshold * union - 1e-9
    np.fill_diagonal(found, False)
    return found


def _verify(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "other": [], "n_texts": [], "n_docs": []}
        order = pc.sort_indices(rows, sort_keys=[("component", "ascending"), ("key", "ascending")])
        rows = rows.take(order)
        component = rows.column("component").to_pylist()
        key, block = rows.column("key").to_pylist(), rows.column("block").to_pylist()
        copies = rows.column("copies").to_numpy()
        blobs = rows.column("shingles").to_pylist()
        cross = rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py()
        cuts = [0, *(i for i in range(1, len(component)) if component[i] != component[i - 1]), len(component)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            # a row of the input can be there twice; its set counts once
            at = [i for i in range(lo, hi) if i == lo or key[i] != key[i - 1]]
            if len(at) < 2:
                continue
            found = similar([np.frombuffer(blobs[i], dtype=np.uint64) for i in at], threshold)
            if cross:
                own = np.array([block[i] for i in at])
                found &= own[:, None] != own[None, :]
            linked = found.any(axis=1)
            parent = list(range(len(at)))

            def root(i: int, parent: list[int] = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            edges = []
            a, b = np.nonzero(np.triu(found))
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = root(i), root(j)
                if x != y:
                    parent[y] = x
                    edges.append((i, j))
            for i in np.flatnonzero(linked).tolist():
                out["key"].append(key[at[i]])
                out["other"].append(None)
                out["n_texts"].append(int(found[i].sum()))
                out["n_docs"].append(int(copies[at][found[i]].sum()))
            for i, j in edges:
                out["key"].append(key[at[i]])
                out["other"].append(key[at[j]])
                out["n_texts"].append(0)
                out["n_docs"].append(0)
        return pa.table([pa.array(out[f.name], f.type) for f in _UNIT_ARROW], schema=_UNIT_ARROW)

    return run


def similarity_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    trees: int = 20,
    recall: float = 0.995,
    max_depth: int = 12,
    block_sets: int = 256,
    block_shingles: int = 300_000,
) -> DataFrame:
    """(doc_id, th, class_id, n_links, n_texts, kept) of every row.

    class_id is the smallest doc_id of the rows that links join, n_links the number of other
    rows at ``threshold`` or above (copies included), n_texts the number of such different
    shingle sets; kept marks one row of each class: its smallest (doc_id, th), where th is the
    hash of the text.  Words are lower-cased, shingles take five.  A text without words has no
    links and is kept; rows that agree in id and text are one row.  Null ids come first.
    """
    depth = prefix_depth(trees, threshold, recall, max_depth)
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )
    sets = persist_table(texts.mapInArrow(_signatures(trees, depth), _SETS), "sets")
    rows = sets.select("doc_id", "th", "key", "n").distinct()
    classes = persist_table(
        sets.where("n > 0")
        .groupBy("key")
        .agg(
            F.min(F.struct("doc_id", "th")).alias("first"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("prefixes").alias("prefixes"),
        ),
        "classes",
    )
    prefixes = classes.select("key", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = prefixes.groupBy("tree", "prefix").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z")
    stars = prefixes.join(shared, ["tree", "prefix"]).select("a", F.col("key").alias("b"))
    component = persist_table(connected_by_leads(stars), "candidates")  # read twice
    sized = component.join(classes.select(F.col("key").alias("node"), "n", "first", "copies"), "node")
    totals = component.join(classes.select(F.col("key").alias("node"), "n"), "node").groupBy("component")
    totals = totals.agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).select(
        "component",
        F.greatest(
            F.ceil(F.col("sets") / F.lit(block_sets)), F.ceil(F.col("shingles") / F.lit(block_shingles))
        ).alias("blocks"),
        "shingles",
    )
    totals = persist_table(totals, "components")
    small = totals.where("blocks = 1").agg(F.sum("shingles")).first()[0] or 0
    bins = F.lit(1 + small // (4 * block_shingles))
    members = sized.join(totals.select("component", "blocks"), "component").select(
        F.col("first.doc_id").alias("__doc"),
        F.col("first.th").alias("__th"),
        F.col("node").alias("key"),
        "component",
        "copies",
        "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"),
    )
    found = texts.join(members, texts["doc_id"].eqNullSafe(F.col("__doc")) & (texts["th"] == F.col("__th"))).select(
        "key", "component", "copies", "blocks", "block", "text"
    )
    schema = found.drop("text").schema.add("shingles", "binary")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    units = found.mapInArrow(_with_shingles, schema).select("*", other)
    units = units.select(
        "key",
        "component",
        "copies",
        "block",
        "shingles",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), bins)).otherwise(F.xxhash64("component")).alias("unit"),
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
    )
    verified = persist_table(units.groupBy("unit", "lo", "hi").applyInArrow(_verify(threshold), _UNIT), "links")
    links = verified.where("other IS NULL").groupBy("key").agg(
        F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs")
    )
    joined = connected_by_leads(verified.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    labelled = (
        classes.select("key", "first", "copies")
        .join(joined.withColumnRenamed("node", "key"), "key", "left")
        .join(links, "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    labelled = persist_table(labelled, "labelled")
    first = labelled.groupBy("component").agg(F.min("first").alias("lead"))
    labelled = labelled.join(first, "component").select(
        "key",
        "lead",
        (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_texts"),
    )
    lead = F.struct("doc_id", "th").eqNullSafe(F.col("lead"))
    full = rows.where("n > 0").join(labelled, "key").select(
        "doc_id", "th", F.col("lead.doc_id").alias("class_id"), "n_links", "n_texts", lead.alias("kept")
    )
    empty = rows.where("n = 0").select(
        "doc_id",
        "th",
        F.col("doc_id").alias("class_id"),
        F.lit(0).cast("bigint").alias("n_links"),
        F.lit(0).cast("bigint").alias("n_texts"),
        F.lit(True).alias("kept"),
    )
    return full.union(empty)
